"""Cross-tokenizer alignment against a plain version, and its parts against the libraries."""

import hashlib
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from querygrade.llm import token_alignment
from querygrade.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def plain_alignment(rows):
    """Every document's digest by walking over its tokens one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = token_alignment.byte_letters()

    def piece_bytes(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece_bytes(i)) for i in pieces.encode(text)]
            if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
                a = b = []
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, token in side:
                at += len(token)
                own.append(at)
            ends.append(own)
        links = [(i, j) for (i, _), e in zip(a, ends[0]) for (j, _), f in zip(b, ends[1]) if e == f] if len(a) * len(b) < 40_000 else None
        if links is None:
            place = {f: j for (j, _), f in zip(b, ends[1])}
            links = [(i, place[e]) for (i, _), e in zip(a, ends[0]) if e in place]
        counts.update(links)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(side, own) if start < e <= cut) for side, own in zip((a, b), ends)))
            start = cut
        docs.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return sorted([(d, x, y, g, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), h) for d, x, y, g, ls, h in docs], key=repr), counts


def texts(n):
    rng = random.Random(9)
    parts = ["the", "café", " ", "  ", "\n", "\t", "漢字", "😀", "<|endoftext|>", "</s>", "<0x41>", "n't", "'ll", "12345", "▁", "xq", "ﬁ", " ", "…", "Ünï", "\r\n", "\x00", "é"]
    rows = [(i, rng.choice(["", " ", "A"]) + "".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(rng.randrange(12)))) for i in range(300)]
    return [*rows, (900, None), (901, ""), (902, "plain words here"), (902, "plain words here"), (None, "plain words"), (903, "w" * 4000)][:n]


@pytest.mark.parametrize("links", [1_000_000, 40])
def test_alignment_against_plain_version(spark, monkeypatch, links):
    monkeypatch.setattr(token_alignment, "CHUNK_LINKS", links)
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 500)
    rows = texts(1000)
    docs = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], "doc_id long, text string, a long, n_a long, chunk string, number long")
    digests, pairs = token_alignment.align_documents(docs, A, B)
    want, counts = plain_alignment(rows)
    assert sorted(map(tuple, digests.collect()), key=repr) == want
    assert sum(w[1] > 0 for w in want) > 100 and sum(w[1] == 0 for w in want) > 5
    assert {(r.a, r.b): r.total for r in pairs.collect()} == dict(counts)


def test_empty_and_tokenless_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    digests, pairs = token_alignment.align_documents(empty, A, B)
    assert digests.collect() == [] and pairs.collect() == []
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert {tuple(r) for r in token_alignment.align_documents(none, A, B)[0].collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)}


def test_long_texts_and_words():
    body = ["x" * 100_000, " " * 60_000 + "a", "ab c\n" * 200_000]
    links, docs = token_alignment.aligned_slice(pa.array(body), token_alignment.sides(A, B))
    assert docs["n_links"].to_pylist()[2] == docs["n_groups"].to_pylist()[2] > 200_000
    assert links.num_rows == sum(docs["n_links"].to_pylist())
    assert all(n > 0 for n in docs["n_a"].to_pylist())


def test_runs_of_a_slice_are_encoded_once():
    class Counting:
        letters = 0

        def __init__(self, model):
            self.model = model

        def encode(self, texts, **options):
            Counting.letters += sum(map(len, texts))
            return self.model.encode(texts, **options)

    one = "words of a text that\ncome back, and come back again: " + " ".join(f"w{i}" for i in range(900))
    side_a, side_b = token_alignment.ByteLevelSide(A), token_alignment.PieceSide(B)
    want = token_alignment.aligned_slice(pa.array([one]), (side_a, side_b))[1].to_pylist()
    side_b.model = Counting(side_b.model)
    assert token_alignment.aligned_slice(pa.array([one] * 60), (side_a, side_b))[1].to_pylist() == want * 60
    assert Counting.letters <= len(one)


def test_runs_and_whole_texts_agree():
    sides = token_alignment.sides(A, B)
    even = [" ".join(f"x{chr(c)}1 {chr(c)}\ny" for c in range(k, k + 64)) for k in range(33, 0x3000, 64)]
    some = pa.array([t for _, t in texts(1000)] + even)
    links, docs = token_alignment.aligned_slice(some, sides)
    whole_links, whole_docs = token_alignment.aligned_slice(some, sides, np.ones(len(some), bool))
    assert links.equals(whole_links) and docs.equals(whole_docs) and docs["n_groups"].to_pylist()[-1] > 60


def test_byte_level_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    some = ["".join(f"x{chr(c)}1 {chr(c)}" for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    mine = token_alignment.sides(A, B)[0].encode(some)
    theirs = [e.ids for e in library.encode_batch([" " + t for t in some], add_special_tokens=False)]
    assert [k for k, (x, y) in enumerate(zip(mine, theirs)) if x.tolist() != y] == []


def test_group_functions_need_no_other_import():
    """The functions that use Arrow's compute module run in a fresh process and import it themselves."""
    code = (
        "import sys, numpy as np, pyarrow as pa\n"
        "from querygrade.llm import jaccard_join, vector_search, token_alignment\n"
        "one = lambda v: np.array([v]).tobytes()\n"
        "lists = pa.table({'bucket': pa.array([0], pa.int32()), 'hot': [False], 'tokens': [one(np.uint32(5))], 'keys': [one(np.int64(1))], 'sizes': [one(np.int32(1))], 'places': [one(np.int32(0))]})\n"
        "jaccard_join._shared_lists(lists)\n"
        "rows = pa.table({'vec_id': [1, 2], 'embedding': pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float32())), 'part': pa.array([0, 0], pa.int32()), 'parts': pa.array([[0], [0]], pa.list_(pa.int32()))})\n"
        "assert vector_search._ranked(rows, rows).num_rows == 2\n"
        "assert jaccard_join.pc is vector_search.pc is sys.modules['pyarrow.compute']\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
