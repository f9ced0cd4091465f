"""Cross-tokenizer alignment: which tokens of two vocabularies end at the same byte of a text.

The first pass cuts slices of whole documents into units: runs between white space, each encoded once for a slice,
and whole texts where runs don't stand alone. It encodes units with both vocabularies and stays in Arrow: the lists of
ids are flattened with their parent indices, a running sum of token lengths restarted at every unit gives each token's
end, and a hash join on (unit, end) gives the links. Both vocabularies end a token where a run ends, so the links and
groups of a document are those of its units, one after the other. Links are grouped into partial counts by pair of ids, which
Spark adds up over the corpus; the links of each slice are stored as numbers in the slice's list of pairs. The second
pass sends every slice the corpus counts of its own pairs and adds them up by document.

Tokens are compared as bytes: a document whose tokens don't give back its text takes no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import ragged, stored, text_slices, utf8_of

#: Bytes of text encoded at once, links and documents gathered before they are stored as one chunk (one document may be larger).
SLICE_BYTES, CHUNK_LINKS, CHUNK_DOCS = 1_000_000, 1_000_000, 20_000
#: How byte-level vocabularies cut a text before merging (fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From this length on a run of white space is encoded by the slower library, as the pattern takes stack for each character of it.
LONG_SPACE = 10_000
#: Texts whose runs don't stand alone: white space beside white space or at an end, other white space than these two, the mark of a piece.
_UNEVEN = "^[ \n]|[ \n]$|[ \n][ \n]|[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{2581}\\x{3000}\\x{feff}]"
#: Runs that are encoded as one text.
TOGETHER = 500

_DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class TokenBytes:
    """Bytes of every id of a vocabulary, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[ids], self.lengths[ids])]


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from 256 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevelSide:
    """Byte-level vocabulary of a tokenizers file; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        letters = byte_letters()
        special = {t["content"] for t in said["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
        self.path, self.library = path, None
        self.encoding = tiktoken.Encoding("byte-level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_id = {i: token for token, i in ranks.items()}
        self.bytes = TokenBytes([by_id.get(i, b"") for i in range(max(by_id) + 1)])

    def _slowly(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def joined(self, text: str, heads: list[int]) -> np.ndarray:
        """Ids of a text that has no white space but single spaces and line ends."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text; none for an empty text."""
        long = re.compile(r"\s{%d}" % LONG_SPACE)
        slow = lambda t: len(t) >= LONG_SPACE and long.search(t) is not None
        none = np.zeros(0, np.int64)
        return [none if not t else self._slowly(" " + t) if slow(t) else np.array(self.encoding.encode_ordinary(" " + t), np.int64) for t in texts]


class PieceSide:
    """Pieces of a sentencepiece file, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p, _ in pieces) and self.model.normalize("a  B\nc") == "▁a▁▁B\nc"
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces])

    def joined(self, text: str, heads: list[int]) -> np.ndarray:
        """Ids of a text, encoded from each head to the next; heads are spaces."""
        ids = self.model.encode([text[s + 1 : e] for s, e in zip(heads, [*heads[1:], len(text)])], num_threads=1)
        return np.fromiter(chain.from_iterable(ids), np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


_sides: dict[tuple[str, str], tuple[ByteLevelSide, PieceSide]] = {}


def sides(path_a: str, path_b: str) -> tuple[ByteLevelSide, PieceSide]:
    """Both vocabularies, read once in each worker."""
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = ByteLevelSide(path_a), PieceSide(path_b)
    return _sides[path_a, path_b]


def id_lists(ids: np.ndarray, sizes: np.ndarray, usable: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(np.where(usable, sizes, 0))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[np.repeat(usable, sizes)]))


def gives_back(ids: np.ndarray, sizes: np.ndarray, tokens: TokenBytes, body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each unit's tokens, joined, are its bytes."""
    ends = np.concatenate(([0], np.cumsum(tokens.lengths[ids])))
    ends = ends[np.concatenate(([0], np.cumsum(sizes)))]
    lengths = np.diff(bounds)
    ok = np.diff(ends) == lengths
    joined = tokens.joined(ids)
    if ok.all() and np.array_equal(joined, body):
        return ok
    rows = np.flatnonzero(ok)
    same = joined[ragged(ends[rows], lengths[rows])] == body[ragged(bounds[rows], lengths[rows])]
    ok[np.repeat(rows, lengths[rows])[~same]] = False
    return ok


def token_ends(lists: pa.ListArray, lengths: pa.Array) -> pa.Table:
    """(doc, end, id, place) of every token: the running sum of token lengths, begun anew at every list."""
    ids, docs = pc.list_flatten(lists), pc.list_parent_indices(lists)
    running = pc.cumulative_sum(pc.take(lengths, ids))
    firsts = pc.subtract(lists.offsets, 1)[:-1]
    before = pc.if_else(pc.less(firsts, 0), 0, pc.take(pa.concat_arrays([running, pa.array([0], pa.int64())]), pc.max_element_wise(firsts, 0)))
    ends = pc.subtract(running, pc.take(before, docs))
    return pa.table({"doc": docs.cast(pa.int64()), "end": ends, "id": ids, "place": pa.array(np.arange(len(ids)))})


def document_links(a: pa.Table, b: pa.Table) -> pa.Table:
    """(doc, end, a, b): all pairs of tokens of a document that end at the same byte, in the order of the text."""
    left = a.select(["doc", "end", "id", "place"]).rename_columns(["doc", "end", "a", "place"])
    right = b.select(["doc", "end", "id"]).rename_columns(["doc", "end", "b"])
    return left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False).sort_by([("place", "ascending")])


def group_texts(a: pa.Table, b: pa.Table, links: pa.Table, units: int) -> tuple[pa.Array, np.ndarray]:
    """Each unit's groups, written a1,a2|b1;a3|b2,b3; with a mark after the last, and their number."""
    width = np.int64(max([0, *(int(pc.max(t["end"]).as_py()) for t in (a, b) if t.num_rows)]) + 1)
    key = lambda t: t["doc"].to_numpy() * width + t["end"].to_numpy()
    cuts = key(links)  # in the order of the text, so that equal ones are neighbours
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])[: len(cuts)]]
    group_a, group_b = np.searchsorted(cuts, key(a)), np.searchsorted(cuts, key(b))
    n_a, n_b = len(group_a), len(group_b)
    place_a = np.arange(n_a) + np.searchsorted(group_b, group_a)
    place_b = np.arange(n_b) + np.searchsorted(group_a, group_b, side="right")
    ids, marks, owner = (np.empty(n_a + n_b, kind) for kind in (np.int64, np.uint8, np.int64))
    for table, group, place, mark in ((a, group_a, place_a, "|"), (b, group_b, place_b, ";")):
        ids[place], owner[place] = table["id"].to_numpy(), table["doc"].to_numpy()
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        marks[place] = np.where(last, ord(mark), ord(","))
    digits = np.ones(len(ids), np.int64)
    while (more := ids >= 10**digits).any():
        digits += more
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    at, left = ends - 2, ids
    while len(left):
        out[at] = 48 + left % 10
        left = left // 10
        at, left = at[left > 0] - 1, left[left > 0]
    bounds = np.concatenate(([0], ends))[np.searchsorted(owner, np.arange(units + 1))]
    written = pa.Array.from_buffers(pa.large_binary(), units, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
    return written, np.bincount(cuts // width, minlength=units)


def text_units(texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(units of each text, their numbers one text after the other, distinct runs): a run begins with a space or a line end.

    Texts of ``whole`` are a unit of their own, numbered behind the runs; null and empty texts have none.
    """
    filled = np.diff(utf8_of(texts)[1]) > 0
    even, odd = np.flatnonzero(filled & ~whole), np.flatnonzero(filled & whole)
    split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)).cast(pa.large_string()), "\n", " \n"), " ")
    coded = pc.list_flatten(split).dictionary_encode()
    runs = [r if r[0] == "\n" else " " + r for r in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    counts = np.zeros(len(texts), np.int64)
    counts[even], counts[odd] = pc.list_value_length(split).to_numpy(), 1
    starts = np.cumsum(counts) - counts
    numbers = np.empty(int(counts.sum()), np.int64)
    numbers[ragged(starts[even], counts[even])] = coded.indices.to_numpy()
    numbers[starts[odd]] = len(runs) + np.arange(len(odd))
    return counts, numbers, runs


def run_ids(side: ByteLevelSide | PieceSide, runs: list[str], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of all runs, encoded as texts of many runs, and the number of ids of each; None if a token lies across two runs."""
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.cumsum([0, *map(len, runs)])
    spaced = np.flatnonzero([r[0] == " " for r in runs])  # the first run of a text is, so the first of all is
    heads = spaced[np.unique(np.searchsorted(spaced, np.arange(0, spaced[-1] + 1, TOGETHER)))]
    ids = side.joined("".join(runs), places[heads].tolist())
    ends = np.cumsum(side.bytes.lengths[ids])
    at = np.searchsorted(ends, bounds[1:], side="right") - 1
    if not len(ids) or at[-1] != len(ids) - 1 or (ends[at] != bounds[1:]).any():
        return None
    return ids, np.diff(at, prepend=-1)


def aligned_slice(texts: pa.Array, sides_: tuple[ByteLevelSide, PieceSide], whole: np.ndarray | None = None) -> tuple[pa.Table, pa.Table]:
    """(links, one row for each document with its counts and the hash of its groups) of a slice of texts.

    Texts of ``whole`` are encoded whole, by default those whose runs don't stand alone.
    """
    if whole is None:
        whole = np.array(pc.match_substring_regex(texts, _UNEVEN).fill_null(False)) | (not sides_[1].apart)
    counts, numbers, runs = text_units(texts, whole)
    alone = [t for t in texts.filter(pa.array(whole)).to_pylist() if t]
    body, bounds = utf8_of(pa.array(runs + [" " + t for t in alone], pa.large_string()))
    ids, sizes = [], []
    for side in sides_:
        found = run_ids(side, runs, bounds[: len(runs) + 1])
        if found is None:
            return aligned_slice(texts, sides_, np.ones(len(texts), bool))
        own = side.encode(alone)
        ids.append(np.concatenate([found[0], *own]))
        sizes.append(np.concatenate((found[1], np.array([len(i) for i in own], np.int64))))
    usable = np.ones(len(bounds) - 1, bool)
    for own, size, side in zip(ids, sizes, sides_):
        usable &= gives_back(own, size, side.bytes, body, bounds)
    docs, owner = len(texts), np.repeat(np.arange(len(texts)), counts)
    if not usable[: len(runs)].all():  # runs that are not given back: their texts decide
        odd = whole.copy()
        odd[owner[~usable[numbers]]] = True
        return aligned_slice(texts, sides_, odd)
    lists = [id_lists(own, size, usable) for own, size in zip(ids, sizes)]
    a, b = (token_ends(own, pa.array(side.bytes.lengths)) for own, side in zip(lists, sides_))
    links = document_links(a, b)
    written, n_groups = group_texts(a, b, links, len(usable))
    n_links = np.bincount(links["doc"].to_numpy(), minlength=len(usable))
    firsts = np.cumsum(n_links) - n_links
    places = pa.array(ragged(firsts[numbers], n_links[numbers]))
    stops = np.cumsum(counts)
    sums = [np.diff(np.concatenate(([0], np.cumsum(n[numbers])))[np.concatenate(([0], stops))]) for n in (*(np.where(usable, s, 0) for s in sizes), n_groups, n_links)]
    text = written.take(pa.array(numbers))
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    out, cuts = memoryview(text.buffers()[2] or b""), ends[np.concatenate(([0], stops))].tolist()
    hashes = ["" if s == e else hashlib.sha256(out[s : e - 1]).hexdigest() for s, e in zip(cuts[:-1], cuts[1:])]
    rows = pa.table([*map(pa.array, sums), pa.array(hashes, pa.string())], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return pa.table([links[c].combine_chunks().take(places) for c in ("a", "b")], ["a", "b"]), rows


_CHUNK = "chunk long, docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, wide boolean, codes binary, pairs array<struct<number:int,a:bigint,b:bigint,n:bigint>>"


def _chunk(number: int, links: list[pa.Table], docs: list[pa.Table]) -> pa.RecordBatch:
    """One stored row: documents, partial counts of their pairs, and every link as the number of its pair."""
    links, docs = pa.concat_tables(links).combine_chunks(), pa.concat_tables(docs).combine_chunks()
    named = pa.array((links["a"].to_numpy() << np.int64(32)) | links["b"].to_numpy()).dictionary_encode()
    codes, names = named.indices.to_numpy(), named.dictionary.to_numpy()
    pairs = pa.table([pa.array(np.arange(len(names)), pa.int32()), names >> np.int64(32), names & np.int64(0xFFFFFFFF), np.bincount(codes, minlength=len(names))], ["number", "a", "b", "n"])
    wide = pairs.num_rows > 65536
    one = lambda t: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.StructArray.from_arrays([c.combine_chunks() for c in t.columns], names=t.schema.names))
    codes = np.ascontiguousarray(codes.astype(np.uint32 if wide else np.uint16)).tobytes()
    return pa.record_batch([pa.array([number], pa.int64()), one(docs), pa.array([wide]), pa.array([codes], pa.binary()), one(pairs)], ["chunk", "docs", "wide", "codes", "pairs"])


def _aligning(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        number, links, docs = TaskContext.get().partitionId() << 32, [], []
        for batch in text_slices(batches, SLICE_BYTES):
            own_links, own_docs = aligned_slice(batch.column(1), both)
            links.append(own_links)
            docs.append(own_docs.add_column(0, "doc_id", batch.column(0)))
            if sum(t.num_rows for t in links) >= CHUNK_LINKS or sum(t.num_rows for t in docs) >= CHUNK_DOCS:
                yield _chunk(number, links, docs)
                number, links, docs = number + 1, [], []
        if docs:
            yield _chunk(number, links, docs)

    return run


def _summed(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one chunk with the sums over their links; ``counts`` has the corpus count of each of its pairs."""
    docs = pa.Table.from_struct_array(pc.list_flatten(chunk["docs"]))
    codes = np.frombuffer(chunk["codes"][0].as_buffer(), np.uint32 if chunk["wide"][0].as_py() else np.uint16)
    total, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    total[counts["number"].to_numpy()] = counts["total"].to_numpy()
    best[counts["number"].to_numpy()] = counts["best"].to_numpy().astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(docs["n_links"].to_numpy())))
    sums = [np.diff(np.concatenate(([0], np.cumsum(values[codes])))[ends]) if len(values) else np.zeros(docs.num_rows, np.int64) for values in (best, total)]
    return pa.table([*docs.columns[:5], pa.array(sums[0]), pa.array(sums[1]), docs["groups_sha256"]], [*docs.schema.names[:5], "n_best", "count_sum", "groups_sha256"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, total, best): links of each pair in the corpus, and whether no pair of the same b has more."""
    totals = chunks.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("total"))
    totals = stored(totals, "totals")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))  # at most a row for each id of the second vocabulary
    return totals.join(F.broadcast(most), "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(digests, pairs): a row for each document, and ``pair_counts`` of the corpus.

    Reads doc_id and text, other columns may have any name. Null and empty texts, and texts that either vocabulary
    can't give back byte for byte, have zeros and an empty hash. Repeated rows are documents of their own; doc_id may
    be null. An empty table gives empty tables.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stored(rows.mapInArrow(_aligning(path_a, path_b), _CHUNK), "chunks")
    pairs = pair_counts(chunks)
    own = chunks.select("chunk", F.inline("pairs")).join(pairs, ["a", "b"]).select(F.col("chunk").alias("of"), "number", "total", "best")
    digests = chunks.select("chunk", "docs", "wide", "codes").groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(_summed, _DIGESTS)
    return digests, pairs
