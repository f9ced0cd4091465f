"""Canonical form of result cells and keys of result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def canonical_cell(column: Column, dtype: T.DataType) -> Column:
    """One cell as a string: equal values of different numeric types give equal strings."""
    if isinstance(dtype, T.DecimalType):
        # Digits that a double would lose stay; where none are lost, the form is that of the other numbers.
        exact = F.round(column, DIGITS)
        held = (F.abs(column) < 10**9) | ((column == F.round(column, 0)) & column.between(-(2**53), 2**53))
        text = exact.cast("string")
        whole = F.regexp_replace(text, r"\.?0+$", "") if dtype.scale > 0 else text
        return F.when(held, canonical_cell(column.cast("double"), T.DoubleType())).otherwise(whole)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = F.round(column.cast("double"), DIGITS)
        plain = F.when(number == 0, "0.0").otherwise(number.cast("string"))
        if isinstance(dtype, T.LongType):
            # Larger whole numbers would lose digits as doubles.
            return F.when(column.between(-(2**53), 2**53), plain).otherwise(column.cast("string"))
        return plain
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(column)
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def bounded_key(key: Column) -> Column:
    """A digest of the key: of one length, whatever the key's."""
    return F.md5(key)


def short_key(key: Column) -> Column:
    """The digest of a key as 16 bytes, a quarter of what the key of a query takes in a shuffle."""
    return F.unhex(bounded_key(key))


def cell_mark(cell: Column) -> Column:
    """Null and empty differ."""
    return F.coalesce(F.concat(F.lit(":"), cell), F.lit("null"))


def row_mark(cells: Column) -> Column:
    """The cells as a JSON array: joined cells cannot run into each other, nulls stay nulls.

    A compiled expression; a ``transform`` over the cells would be interpreted per row.
    """
    return F.coalesce(F.to_json(cells), F.lit("null"))


def cell_key(cell: Column) -> Column:
    return bounded_key(cell_mark(cell))


def row_key(cells: Column) -> Column:
    return bounded_key(row_mark(cells))


def query_key(db_id: Column, sql: Column) -> Column:
    """Key of one query on one database, used by the result cache."""
    return F.sha2(F.concat_ws("\u0001", db_id, sql), 256)
