"""Top-k search and centroid clustering against brute force, and odd tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from siftwell.llm import centroids as cen
from siftwell.llm import topk
from siftwell.llm.centroids import centroid_clusters
from siftwell.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label long, e string, r string, cell string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def plain_top(rows, k=10, scale=1024):
    good = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is None or i % 100:
            continue
        hits = sorted((-sum(a * b for a, b in zip(q, x)), math.inf if j is None else j) for m, j, x in good if m != n and len(x) == len(q))
        out += [(i, rank, None if j == math.inf else j, -s) for rank, (s, j) in enumerate(hits[:k], 1)]
    return sorted(out, key=str)


def table(seed=2, n=900, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32) / 8
    x[: n // 3] = x[0]  # copies of one vector are a third of all rows
    x[n // 3 : n // 3 + 40] = 0
    return [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(2 * n)[:n], x)]


ODD = [(None, [0.5] * 64), (100, None), (200, []), (300, [0.1, None] * 32), (400, [float("nan")] * 64), (500, [float("inf")] * 64), (600, [0.25] * 3), (700, [-0.5] * 3), (800, [0.5] * 64), (800, [0.5] * 64), (801, [1e-9] * 64)]


@pytest.mark.parametrize("leaf, cells, queries", [(128, 1024, 16384), (8, 8, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, leaf, cells, queries):
    monkeypatch.setattr(topk, "CELLS", cells)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rows = table() + ODD
    got = sorted((tuple(r) for r in top_k(frame(spark, rows)).collect()), key=str)
    assert got == plain_top(rows)


def test_top_k_of_few_and_none(spark):
    assert top_k(frame(spark, [])).collect() == []
    rows = [(100, [1.0, 2.0]), (7, [1.0, 0.5]), (8, [1.0, 0.5])]
    assert [tuple(r) for r in top_k(frame(spark, rows)).orderBy("rank").collect()] == [(100, 1, 7, 2097152), (100, 2, 8, 2097152)]


def test_search_is_exact_beyond_doubles_and_stops_early():
    rng = np.random.default_rng(4)
    x = rng.integers(-(10**8), 10**8, (600, 16))
    q, ids, rows = x[:20], rng.permutation(600), np.arange(600)
    s = q @ x.T
    s[np.arange(20), np.arange(20)] = topk.NO_SCORE
    want = np.stack([np.lexsort((ids, ~v))[:10] for v in s])
    start = np.full(20, topk.NO_SCORE), np.full(20, topk.NONE)
    best, id_ = topk.search(topk.grow(x, ids, 16), x, ids, rows, q, rows[:20], 10, *start)
    assert (id_ == ids[want]).all() and (best == np.take_along_axis(s, want, 1)).all()
    kth = np.take_along_axis(s, want, 1)[:, -1], ids[want][:, -1]
    again, _ = topk.search(topk.grow(x, ids, 16), x, ids, rows, q, rows[:20], 10, *kth)
    assert (again == best).all()
    beyond, _ = topk.search(topk.grow(x, ids, 16), x, ids, rows, q, rows[:20], 10, kth[0] * 0 + 2**62, kth[1])
    assert (beyond == topk.NO_SCORE).all()


def test_boxes_keep_leaves_out():
    """On vectors in narrow groups a search looks at a part of the leaves only."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (200, 8)) for c in rng.normal(size=(20, 8)) * 100]).round()
    tree = topk.grow(x, np.arange(len(x)), 50)
    seen = []
    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype == np.int64 and at.ndim == 1:
                seen.append(len(at))
            return super().__getitem__(at)
    topk.search(tree, x.view(Watched), np.arange(len(x)), np.arange(len(x)), x[:1], np.arange(1), 10, np.full(1, -np.inf), np.full(1, topk.NONE))
    assert 0 < sum(seen) < len(x) / 4


def plain_clusters(rows, k=16, rounds=3, scale=64):
    kept = [(i, v, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [x for _, _, x in sorted(kept, key=lambda t: (digest(t[0]), t[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = [near(x)[1] for _, _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, _, x), o in zip(kept, of) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    last = [near(x) for _, _, x in kept]
    sums = [sum(d for d, j in last if j == m) for m in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted([(i, j, d, sums[j], sum(sums), sha[j]) for (i, _, _), (d, j) in zip(kept, last)], key=str)


def test_clusters_equal_brute_force(spark):
    rows = table(seed=3, n=400) + ODD
    assert sorted((tuple(r) for r in centroid_clusters(frame(spark, rows)).collect()), key=str) == plain_clusters(rows)


def test_clusters_of_few_none_and_large_components(spark):
    assert centroid_clusters(frame(spark, [])).collect() == []
    assert centroid_clusters(frame(spark, ODD[1:6])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1e5, 1e5) for _ in range(64)]) for i in range(12)] + [(50 + i, [0.5] * 64) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in centroid_clusters(df).collect()), key=str) == plain_clusters(rows)


def test_transform_is_orthogonal_and_nearest_exact():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-60, 60, (500, 64)), rng.integers(-60, 60, (16, 64))
    c[5] = c[3]
    assert (cen.transform(np.eye(64, dtype=np.int64)) @ cen.transform(np.eye(64, dtype=np.int64)).T == 64 * np.eye(64)).all()
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    n, far = cen.nearest(x, c)
    assert (n == d.argmin(1)).all() and (far == d.min(1)).all()
