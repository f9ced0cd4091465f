"""The n-gram Jaccard join against all pairs, its search against counting, and classes against rounds."""

import random
import re

import numpy as np
import pytest

from querygrade.llm import common, jaccard_join, jaccard_links
from querygrade.llm.shingles import shingle_sets

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_classes(rows):
    sets = {i: plain_set(t) for i, t in rows}
    smallest = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]) and smallest[j] < smallest[i]:
                    smallest[i], changed = smallest[j], True
    close = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0
    return {i: (len(sets[i]), smallest[i], sum(close(i, j) for j in sets if j != i)) for i in sets}


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(40))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 30, 80]))] + passage.split() * (rng.random() < 0.5)
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("long_list, block", [(64, 2048), (1, 2)])
def test_classes_against_all_pairs(spark, documents, monkeypatch, long_list, block):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_links, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "HOT_FROM", 3)
    rows = texts(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_classes(documents(rows)).collect()}
    assert got == plain_classes(rows)
    assert len({c for _, c, _ in got.values()}) < len(rows) and max(n for *_, n in got.values()) > 2


def test_odd_rows(odd_documents):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(odd_documents).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, 3, 8)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (8, 0, 8)]
    assert [g for g in got if g[0] == 4] == [(4, 1, 4)] * 2 and [g[2] for g in got if g[0] in (5, 6)] == [5, 5]
    assert (None, 2, None) in got or any(g[0] is None for g in got)


def test_empty_table(documents):
    assert jaccard_join.jaccard_classes(documents([])).count() == 0


def test_shingles_as_words_say():
    rows = ["", "A b\tc", "a B c", "x\x0by z w v u", "one two three four five", "ONE two three four five six"]
    data = [r.encode() for r in rows]
    sets = shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))
    assert [len(s) for s in sets] == [0, 1, 1, 2, 1, 2] and (sets[1] == sets[2]).all() and len(np.intersect1d(sets[4], sets[5])) == 1


def test_divide_skip_against_counting():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        lists = [np.flatnonzero(rng.random(n) < rng.choice([0.05, 0.5, 0.95])) for _ in range(int(rng.integers(0, 25)))]
        needed = rng.integers(1, 12, n)
        counts = sum((np.isin(np.arange(n), own).astype(int) for own in lists), np.zeros(n, int))
        assert (jaccard_join.divide_skip(np.zeros(0, np.uint64), [x for x in lists if len(x)], needed) == (counts >= needed)).all()


def test_search_of_lists_against_counting():
    """Sets of a group of near copies, of unrelated sets and of both: the same sets reach the overlap as by counting."""
    rng = np.random.default_rng(9)
    for kind in range(60):
        n, base = int(rng.integers(1, 60)), np.arange(200, dtype=np.uint64)
        sets = []
        for _ in range(n):
            near = kind % 3 == 0 or (kind % 3 == 1 and rng.random() < 0.5)
            own = base[rng.random(200) > 0.04] if near else np.zeros(0, np.uint64)
            other = rng.integers(200, 400, int(rng.integers(1, 30))).astype(np.uint64)
            sets.append(np.unique(np.concatenate((own, other))))
        lists = jaccard_links.Lists(sets)
        for probe in [*sets[:10], np.arange(150, 260, dtype=np.uint64), np.array([1000], np.uint64)]:
            want = [k for k, s in enumerate(sets) if len(np.intersect1d(probe, s)) >= jaccard_join.required(len(s), len(probe))]
            assert lists.search(probe, jaccard_join.required).tolist() == want


def test_rounds_and_one_task_agree(spark):
    rng = random.Random(1)
    links = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "x long, y long")
    one = {tuple(r) for r in common.connected_classes(links, "x", "y").collect()}
    assert one == {tuple(r) for r in common.connected_classes(links, "x", "y", most=0).collect()}
