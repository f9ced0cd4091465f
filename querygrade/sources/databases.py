"""Databases as folders of Parquet tables, and their catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "db_id string, table_name string, column_name string, ordinal int"


def table_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name to path, for every Parquet file and every folder right under a database folder; one level is listed."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    entries = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    found = {}
    for entry in entries:
        name = entry.getPath().getName()
        if not name.startswith(("_", ".")) and (entry.isDirectory() or name.endswith(".parquet")):
            found[name.removesuffix(".parquet")] = f"{folder.rstrip('/')}/{name}"
    return dict(sorted(found.items()))


def attach_database(spark: SparkSession, folder: str) -> SparkSession:
    """A separate session that sees the tables of one database as views, and no other files."""
    session = spark.newSession()
    for setting in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(setting, spark.conf.get(setting))
    session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    session.conf.set("spark.sql.maxMetadataStringLength", str(2**31 - 1))  # a plan names every path and column
    for name, path in table_paths(spark, folder).items():
        session.read.parquet(path).createOrReplaceTempView("`" + name.replace("`", "``") + "`")
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    return session


def catalog_rows(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """``(db_id, table_name, column_name, ordinal)`` of the named database folders. Reads schemas only."""
    rows = [
        (db_id, table, column, ordinal)
        for db_id, folder in folders.items()
        for table, path in table_paths(spark, folder).items()
        for ordinal, column in enumerate(spark.read.parquet(path).columns)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def catalog_tables(catalog: DataFrame) -> DataFrame:
    """``(db_id, table_name, columns)`` with the columns in table order."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "column_name")))
    return catalog.groupBy("db_id", "table_name").agg(F.transform(ordered, lambda c: c.column_name).alias("columns"))


def catalog_map(catalog: DataFrame) -> DataFrame:
    """``(db_id, tables)``: a map from table to its columns."""
    entries = F.collect_list(F.struct("table_name", "columns"))
    return catalog_tables(catalog).groupBy("db_id").agg(F.map_from_entries(entries).alias("tables"))
