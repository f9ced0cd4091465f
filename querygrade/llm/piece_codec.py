"""SentencePiece encoding and decoding by batched Viterbi over the pieces of a model file.

Words of equal length advance together, one character a step. Hashes of all substrings that end at the step
probe the sorted hashes of the pieces; the best predecessor of each word is a vectorised maximum, stored as a
back pointer. For a model of kind "unigram" a path's value is the sum of its scores. For kind "bpe" a piece may
only follow a piece that merging would leave beside it, which leaves one path: the one the merges make.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import CACHES, frugal, text_slices
from querygrade.llm.token_ids import ENCODING, TextEncoder

SPACE = "▁"
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words of one length that advance together.
TOGETHER = 20_000

_BASE = np.uint64(0x100000001B3)
_NEVER = np.int64(1) << 60
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_RAW = "\r\r"


class PieceModel(TextEncoder):
    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        self.kind = kind
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.vocab_size()
        self.pieces = [own.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p in (self.pieces[i] for i in usable)) or own.normalize(" a  B") != " a  B".replace(" ", SPACE).join((SPACE, "")):
            raise ValueError("the model joins words or changes texts")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if own.is_byte(i)}
        self.unknown_id = own.unk_id()
        self.shown = [SPACE if own.is_unknown(i) else "" if own.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        for b, i in self.bytes.items():
            self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.unknown = n  # stands for one character without a piece
        scores = np.array([own.get_score(i) for i in range(n)] + [0.0])
        scores[n] = scores[usable].min() - UNKNOWN_PENALTY
        self.scores = scores
        self._splits(usable)
        self._tables([i for i in usable if kind != "bpe" or self.reached[i]])
        self._forget()

    def _splits(self, usable: list[int]) -> None:
        """The merge that makes each piece, its place in the order of merges, and all pairs that merge."""
        n = self.unknown + 1
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.reached = np.ones(n, bool)
        if self.kind != "bpe":
            return
        ids = {self.pieces[i]: i for i in usable}
        order = {p: k for k, p in enumerate(sorted((p for p in ids if len(p) > 1), key=lambda p: (-self.scores[ids[p]], ids[p])))}
        pairs, ranks = [], []
        for piece, rank in order.items():
            i = ids[piece]
            self.rank[i] = rank
            for cut in range(1, len(piece)):
                if piece[:cut] in ids and piece[cut:] in ids:
                    pairs.append(ids[piece[:cut]] * n + ids[piece[cut:]])
                    ranks.append(rank)
            parts = list(piece)
            while len(parts) > 2:
                best = min((order.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if best[0] >= rank:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and parts[0] in ids and parts[1] in ids:
                self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
            else:
                self.reached[i] = False
        at = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.pair_ranks = np.array(pairs, np.int64)[at], np.array(ranks, np.int64)[at]

    def _tables(self, usable: list[int]) -> None:
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i in usable:
            h = 0
            for c in self.pieces[i]:
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
            by_length.setdefault(len(self.pieces[i]), []).append((h, i))
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            self.tables[length] = (np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64))
        self.longest = max(by_length)

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b leaves exactly these two: undo their merges, latest first,
        and see that no merge over the border would have come before the one undone."""
        result = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), _NEVER)
        while len(live):
            key = a * (self.unknown + 1) + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            over = np.where(self.pairs[at] == key, self.pair_ranks[at], _NEVER)
            lost = over < limit
            result[live[lost]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            going = ~lost & ((rank_a >= 0) | (rank_b >= 0))
            first = rank_a > rank_b
            limit = np.where(first, rank_a, rank_b + 1)[going]
            a, b = np.where(first, self.right[a], a)[going], np.where(first, b, self.left[b])[going]
            live = live[going]
        return result

    def _viterbi(self, words: np.ndarray) -> list[list[int]]:
        """Best piece ids of words of one length, given as rows of code points."""
        rows, n = words.shape
        prefix = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * _BASE + words[:, i].astype(np.uint64) + np.uint64(1)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        last, step = np.zeros((n + 1, rows), np.int64), np.zeros((n + 1, rows), np.int64)
        for i in range(1, n + 1):
            reach = min(i, self.longest)
            value, piece = np.full((reach, rows), -np.inf), np.full((reach, rows), self.unknown)
            for length in range(1, reach + 1):
                if length not in self.tables:
                    continue
                hashes, ids = self.tables[length]
                own = prefix[i] - prefix[i - length] * np.uint64(pow(int(_BASE), length, 1 << 64))
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == own)
                found = ids[at[hit]]
                if self.kind == "bpe" and i > length:
                    fits = self._beside(last[i - length][hit], found)
                    hit, found = hit[fits], found[fits]
                piece[length - 1, hit] = found
                value[length - 1, hit] = best[i - length][hit] + self.scores[found]
            lone = self._lacking(words[:, i - 1])
            value[0, lone], piece[0, lone] = best[i - 1][lone] + self.scores[self.unknown], self.unknown
            choice = value.argmax(axis=0)
            cols = np.arange(rows)
            best[i], last[i], step[i] = value[choice, cols], piece[choice, cols], choice + 1
        out: list[list[int]] = [[] for _ in range(rows)]
        at = np.full(rows, n)
        live = np.arange(rows)
        while len(live):
            for r, p, end in zip(live.tolist(), last[at, live].tolist(), at.tolist()):
                out[r].extend([p] if p != self.unknown else self._unknown_ids(chr(words[r, end - 1]))[::-1])
            at = at - step[at, live]
            live, at = live[at > 0], at[at > 0]
        return [ids[::-1] for ids in out]

    def _lacking(self, chars: np.ndarray) -> np.ndarray:
        hashes, _ = self.tables[1]
        own = chars.astype(np.uint64) + np.uint64(1)
        return np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] != own)

    def _unknown_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown_id]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        by_length: dict[int, list[int]] = {}
        for k, text in enumerate(texts):
            by_length.setdefault(len(text), []).append(k)
        for n, rows in by_length.items():
            for a in range(0, len(rows) if n else 0, TOGETHER):
                own = rows[a : a + TOGETHER]
                codes = np.frombuffer("".join(texts[k] for k in own).encode("utf-32-le", "surrogatepass"), np.uint32)
                for k, ids in zip(own, self._viterbi(codes.reshape(len(own), n))):
                    out[k] = ids
        return out

    def _runs(self, text: str) -> list[str]:
        if "  " in text or " \n" in text or "\n\n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "\r" in text or SPACE in text:
            return [_RAW + w for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def _string(self, key: str) -> str:
        return key[2:] if key[:2] == _RAW else key if key[0] == "\n" else SPACE + key

    def _parts(self, key: str) -> tuple[str, str, str]:
        return "", "", ""

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: pieces joined, marks back to spaces, the first one dropped; wrong bytes as U+FFFD."""
        text = "".join(map(self.shown.__getitem__, ids.tolist()))
        if not text.isascii() and re.search("[\udc80-\udcff]", text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_models: dict[tuple[str, str], PieceModel] = {}
CACHES.setdefault(ENCODING, []).append(_models)


def piece_model(path: str, kind: str) -> PieceModel:
    if (path, kind) not in _models:
        _models[path, kind] = PieceModel(path, kind)
    return _models[path, kind]


def _encoded(batches: Iterator[pa.RecordBatch], model: str, kind: str) -> Iterator[pa.RecordBatch]:
    encode = piece_model(model, kind).encode
    for batch in text_slices(batches):
        ids = [i.astype("<u4").tobytes() for i in encode(batch.column(1).to_pylist())]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model: str, kind: str) -> Iterator[pa.RecordBatch]:
    decode = piece_model(model, kind).decode
    for batch in text_slices(batches, column="ids"):
        texts = [decode(np.frombuffer(i or b"", "<u4")) for i in batch.column(2).to_pylist()]
        yield batch.append_column("decoded", pa.array(texts, pa.string()))


def encode_pieces(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """Columns doc_id, text, ids for every row of ``docs``: ids are little-endian unsigned 32-bit piece ids.

    Null and empty texts have no ids. Characters without a piece become their UTF-8 bytes, or the unknown id if
    the model has none. Repeated rows come out once each; columns besides doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, model, kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run, ENCODING), "doc_id long, text string, ids binary")


def decode_pieces(encoded: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """Adds the column ``decoded``, the text of ``ids``, to columns doc_id, text, ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, model, kind)

    return encoded.select("doc_id", "text", "ids").mapInArrow(frugal(run, ENCODING), "doc_id long, text string, ids binary, decoded string")


def recode_pieces(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """Columns doc_id, text, ids, decoded: as ``decode_pieces`` after ``encode_pieces``, both in one worker a task.

    Two steps would keep two workers a core, each with the runs it remembers, and batches of whole ids between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, model, kind), model, kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run, ENCODING), "doc_id long, text string, ids binary, decoded string")


def piece_digests(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """Columns doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip of every document (null text as empty)."""
    return recode_pieces(docs, model, kind).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
