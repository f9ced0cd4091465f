"""Near copies of vectors against all pairs, centroid clusters against all distances."""

import hashlib
import math

import numpy as np
import pytest

from querygrade.llm import centroid_clusters, vector_dedup

VECTORS = "vec_id long, embedding array<float>, label int, node int, h1 string, class string, distance int, near int"


def frame_of(spark, rows):
    """Rows of (vec_id, vector), with further columns named like the operators' own."""
    return spark.createDataFrame([(i, v, 1, 2, "x", "y", 3, 4) for i, v in rows], VECTORS)


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def plain_copies(rows, share=0.95):
    """n_links and component of every row by all pairs."""
    vectors = [np.array(v, np.float32).astype(np.float64) if usable(v) else None for _, v in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= share:
                links[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, left = {i}, [i]
        while left:
            for j in links[left.pop()]:
                if j not in seen:
                    seen.add(j)
                    left.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), first, rows[i][0] == first))
    return sorted(out, key=repr)


def planted(seed, n, length):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, length))
    rows = [base[k] for k in range(n)]
    for k in range(n // 3):  # chains and groups around a few vectors
        rows.append(rows[k % 7] + rng.standard_normal(length) * rng.choice([0.05, 0.2, 0.33]) * np.linalg.norm(rows[k % 7]) / math.sqrt(length))
    rows += [rows[3] * 2, rows[3] * 1e-20, rows[4] * 1e18, rows[5], rows[5]]
    return [(int(i), [float(x) for x in v.astype(np.float32)]) for i, v in zip(rng.permutation(len(rows)) * 3, rows)]


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_against_all_pairs(spark, monkeypatch, small):
    if small:  # many intervals, levels and leaves
        monkeypatch.setattr(vector_dedup, "FEWEST_ROWS", 5)
        monkeypatch.setattr(vector_dedup, "INTERVALS", 40)
        monkeypatch.setattr(vector_dedup, "LEAF", 3)
    zero, odd = [0.0] * 16, [1.0] * 15 + [None]
    rows = planted(1, 120, 16) + planted(2, 20, 5) + planted(3, 6, 1)
    rows += [(9001, zero), (9002, None), (9003, odd), (9004, [float("nan")] * 16), (9005, [float("inf")] + [1.0] * 15), (9006, []), (None, rows[0][1]), (None, None)]
    rows += [rows[0], rows[0], (-7, rows[1][1])]
    found = vector_dedup.near_copies(frame_of(spark, rows))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_copies(rows)


def test_near_copies_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "FEWEST_ROWS", 64)
    rng = np.random.default_rng(4)
    near = rng.standard_normal(64) + rng.standard_normal((600, 64)) * 0.1
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate((near, np.tile(near[:1], (300, 1)))))]
    assert sorted(map(tuple, vector_dedup.near_copies(frame_of(spark, rows)).collect()), key=repr) == plain_copies(rows)


def test_intervals_far_apart_are_skipped(spark):
    """Two tight groups: no leaf of one is compared with a leaf of the other, nor an interval."""
    rng = np.random.default_rng(5)
    groups = [np.eye(8)[k] + rng.standard_normal((50, 8)) * 0.01 for k in (0, 1)]
    a, b = (vector_dedup.Side([{"first": 0, "body": g.tobytes(), "copies": np.ones(50, np.int64).tobytes()}], 8, np.float64, None) for g in groups)
    assert list(vector_dedup.close_leaves(a, b, math.sqrt(0.1))) == []
    assert list(vector_dedup.close_leaves(a, a, math.sqrt(0.1))) == [(0, 0)]
    flat = [s.flat.astype(float) for s in (a, b, a)]
    boxes = [(8, k, f.min(axis=0).tolist(), f.max(axis=0).tolist()) for k, f in zip((0, 17, 40), flat)]
    slices = spark.createDataFrame(boxes, "length int, interval long, low array<double>, high array<double>")
    pairs = {(r.x, r.y) for r in vector_dedup.close_intervals(slices, 40, math.sqrt(0.1)).collect()}
    assert pairs == {(0, 0), (17, 17), (40, 40), (0, 40)}


def test_descriptions_never_understate_a_cosine():
    rng = np.random.default_rng(6)
    unit = vector_dedup.unit_rows(rng.standard_normal((300, 40)))
    leading = np.linalg.qr(rng.standard_normal((40, vector_dedup.LEADING)))[0]
    for flat in (vector_dedup.described(unit, leading), vector_dedup.described(unit, None)):
        assert (flat.astype(float) @ flat.T.astype(float) >= unit @ unit.T - vector_dedup.ROUGH).all()


def test_empty_tables(spark):
    assert vector_dedup.near_copies(frame_of(spark, [])).collect() == []
    assert centroid_clusters.cluster_digests(frame_of(spark, [])).collect() == []
    assert [tuple(r) for r in vector_dedup.near_copies(frame_of(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def plain_clusters(rows, count, rounds, dims):
    kept = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:count]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own) if c == k]
            if members:
                centroids[k] = [sum(col) // len(members) for col in zip(*members)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in last)
    sizes = {k: sum(d for _, c, d in last if c == k) for k in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, k, d, sizes[k], total, names[k]) for i, k, d in last)


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((9, 64))
    rows = [(int(i), (centres[i % 9] * 0.3 + rng.standard_normal(64) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, [0.25] * 64) for i in range(50)]  # ties between equal centroids
    rows += [(600, None), (601, [1.0] * 63), (602, [None] + [1.0] * 63), (603, [float("nan")] * 64), (604, [float("inf")] * 64), rows[0], rows[0]]
    found = centroid_clusters.cluster_digests(frame_of(spark, rows)).collect()
    assert sorted(map(tuple, found)) == plain_clusters(rows, 40, 5, 64)


def test_fewer_vectors_than_centroids_and_large_integers(spark):
    rows = [(1, [1.0] * 64), (2, [-1.0] * 64), (3, [1e30] + [0.0] * 63)]
    found = centroid_clusters.cluster_digests(frame_of(spark, rows)).collect()
    assert sorted(map(tuple, found)) == plain_clusters(rows[:2], 40, 5, 64)
    found = centroid_clusters.cluster_digests(frame_of(spark, rows[:1])).collect()
    assert sorted(map(tuple, found)) == plain_clusters(rows[:1], 40, 5, 64)


def test_bounds_spare_distances():
    """After a small move of the centroids most vectors are settled by their bounds, and the rest by a small ball."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-1000, 1000, (40, 64))
    x = centres[rng.integers(0, 40, 2000)] + rng.integers(-60, 60, (2000, 64))
    near, second = np.zeros(2000, np.int64), np.ones(2000, np.int64)
    upper, lower = np.full(2000, np.inf), np.full(2000, -np.inf)
    first = centroid_clusters.shallot(x, centres, centroid_clusters.Neighbours(centres), near, second, upper, lower)
    assert first <= 2000 * 41
    moved = centres + 1
    bounds = centroid_clusters._moved((upper, lower), near, centroid_clusters._above(centroid_clusters._squared(moved, centres)))
    again = centroid_clusters.shallot(x, moved, centroid_clusters.Neighbours(moved), near, second, *bounds)
    assert again < 2000 * 4
    assert (near == ((x[:, None, :] - moved) ** 2).sum(axis=2).argmin(axis=1)).all()
