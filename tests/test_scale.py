"""Ranges, running values, doubling, re-banding, exchange and suppression: results against plain models, and how work is dealt out."""

import hashlib
import math
import random
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import aggregates as A
from siftwell.operators import integrity as I
from siftwell.operators import ranges as R
from siftwell.operators import selection as X
from siftwell.operators import similarity as S
from siftwell.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    """200,000 rows: scores of `far` are near 0 but for one of 1e12, those of `tied` all equal, `few` has three rows."""
    n = F.col("id")
    far = spark.range(98_000).select(F.lit("far").alias("g"), n.alias("k"), F.when(n == 7, 1e12).otherwise(F.pmod(F.xxhash64(n), F.lit(10_007)) / 10_007).alias("s"))
    tied = spark.range(101_997).select(F.lit("tied"), n, F.lit(0.5))
    few = spark.createDataFrame([("few", 1, None), ("few", 2, float("nan")), ("few", 3, 2.0)], "g string, k long, s double")
    return far.union(tied).union(few)


def test_no_range_holds_much_of_a_group(skewed):
    rows = R.sliced(skewed, ["g"], R.falling("s", "k"))
    share = rows.groupBy("g", "_slice").count().groupBy("g").agg((F.max("count") / F.sum("count")).alias("most"), F.sum("count").alias("n"))
    told = {r["g"]: r for r in share.collect()}
    assert told["far"]["most"] <= 0.02 and told["tied"]["most"] <= 0.02
    assert {g: r["n"] for g, r in told.items()} == {"far": 98_000, "tied": 101_997, "few": 3}


def test_ranks_of_skewed_scores(skewed):
    got = W.score_rank(skewed, ["g"], "s", ["k"], "r")
    want = np.argsort(-np.array([r["s"] for r in skewed.where("g = 'far'").orderBy("k").select("s").collect()]), kind="stable")
    far = {r["k"]: r["r"] for r in got.where("g = 'far'").select("k", "r").collect()}
    assert [far[int(k)] for k in want] == list(range(1, 98_001))
    assert got.where("g = 'tied' and r <> k + 1").count() == 0
    assert [r["k"] for r in got.where("g = 'few'").orderBy("r").collect()] == [3, 2, 1]


def test_quantiles_of_skewed_values(skewed):
    got = {r["g"]: r for r in A.describe_exact(skewed.where("g <> 'few'"), "s", ["g"]).collect()}
    far = [r["s"] for r in skewed.where("g = 'far'").select("s").collect()]
    assert [got["far"][c] for c in ("q1", "median", "q3")] == pytest.approx(np.percentile(far, [25, 50, 75]).tolist())
    assert [got["tied"][c] for c in ("q1", "median", "q3")] == [0.5] * 3


def test_ranks_of_nothing_and_null_groups(spark):
    assert W.score_rank(spark.createDataFrame([], "g string, k long, s double"), ["g"], "s", ["k"], "r").collect() == []
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 3, 1.0)], "g string, k long, s double")
    assert {(r["g"], r["k"], r["r"]) for r in W.score_rank(df, ["g"], "s", ["k"], "r").collect()} == {(None, 2, 1), (None, 1, 2), ("a", 3, 1)}


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges of 3 rows, so that a group of some hundred is cut into very many."""
    monkeypatch.setattr(R, "PER_RANGE", 3)
    monkeypatch.setattr(R, "LEAST", 3)


def series(seed, n=400):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else f"j{rng.randrange(30)}", i, None if rng.random() < 0.05 else round(rng.random(), 3)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_a_hot_series_is_spread_and_equal(spark, small_ranges):
    rows = series(1)
    df = spark.createDataFrame(rows, "job string, at long, v double").withColumn("ts", F.timestamp_seconds(F.col("at") * 7))
    assert R.sliced(df, ["job"], R.rising("at")).where("job = 'hot'").select("_slice").distinct().count() > 30
    got = {(r["job"], r["at"]): r for r in W.attempts(W.eta(df, "job", ["at"], "v", 300), "job", ["at"], "ts").collect()}
    by = defaultdict(list)
    for job, at, v in sorted(rows, key=lambda r: r[1]):
        by[job].append((at, v))
    for job, steps in by.items():
        for i, (at, _) in enumerate(steps):
            last = [v for _, v in steps[max(0, i - 4) : i + 1] if v is not None]
            r = got[job, at]
            assert r["done"] == r["attempt"] == i + 1
            assert r["seconds"] == (None if i + 1 == len(steps) else 7 * (steps[i + 1][0] - at))
            assert r["recent"] == (pytest.approx(sum(last) / len(last)) if last else None)
            assert not last or r["remaining"] == pytest.approx((300 - i - 1 if i < 299 else 0) * sum(last) / len(last))


def sequential_usage(rows, quota, allowed, others, memory):
    used, by_domain, by_background, recent, out = Counter(), Counter(), Counter(), deque(maxlen=memory), {}
    for n, obj, domain, background in rows:
        left = max(0, quota - used[obj])
        guide = (left, left / quota, by_domain[obj, domain] / allowed.get(domain, others), float(by_background[obj, background]), float(obj in recent))
        out[n] = (used[obj], *guide, 0.06 * guide[1] - 0.08 * guide[2] - 0.18 * guide[3] - 0.10 * guide[4] - 0.30 * (n % 3 == 0))
        used[obj] += 1
        by_domain[obj, domain] += 1
        by_background[obj, background] += 1
        recent.append(obj)
    return out


@pytest.mark.parametrize("memory", [1, 4, 9])
def test_usage_equals_a_sequential_memory(spark, small_ranges, memory):
    rng = random.Random(memory)
    rows = [(n, "hot" if rng.random() < 0.5 else rng.choice("abcdefghij"), rng.choice(["snow", "rain", "sun"]), rng.randrange(12)) for n in range(300)]
    df = spark.createDataFrame(rows, "n long, obj string, domain string, background long")
    out = W.usage_guidance(df, "obj", "domain", "background", ["n"], 40, {"snow": 1}, 5, memory, F.when(F.col("n") % 3 == 0, 1.0).otherwise(0.0))
    cols = ["used", "remaining_quota", "quota_bonus", "domain_repeat_penalty", "background_repeat_penalty", "recent_history_penalty", "adjustment"]
    want = sequential_usage(rows, 40, {"snow": 1}, 5, memory)
    got = {r["n"]: [r[c] for c in cols] for r in out.collect()}
    assert {n: pytest.approx(v) for n, v in got.items()} == {n: list(v) for n, v in want.items()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    plain = I.durable
    monkeypatch.setattr(I, "durable", lambda df: written.append(1) or plain(df))
    chain = spark.range(10_000).selectExpr("id as node", "id + 1 as dependency").where("node < 9999")
    start = spark.createDataFrame([(0,), (9_990,)], "node long")
    got = I.upstream(chain, start).groupBy("start").count().collect()
    assert {r["start"]: r["count"] for r in got} == {0: 10_000, 9_990: 10}
    assert len(written) < 3 * 20  # three tables a round
    written.clear()
    levels = I.check_graph(spark.range(10_000).withColumnRenamed("id", "node"), chain)
    assert levels.where("level <> 9999 - node or problem is not null").count() == 0
    assert len(written) < 40


def test_closures_of_cycles_and_deep_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(60, 40)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(5)]
    e = spark.createDataFrame(edges, "node long, dependency long")
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    want = set()
    for s in (0, 30, 60):
        todo = [s]
        while todo:
            x = todo.pop()
            if (s, x) not in want:
                want.add((s, x))
                todo += to[x]
    got = {(r["start"], r["node"]) for r in I.upstream(e, spark.createDataFrame([(0,), (30,), (60,)], "node long")).collect()}
    assert got == want


def test_bands_that_half_of_all_rows_share(spark):
    rng = random.Random(9)
    sigs = [(rng.getrandbits(96) << 32) if i % 2 else rng.getrandbits(128) for i in range(260)]
    sigs += [s ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for s in sigs[:60]] + [sigs[1]] * 200
    df = spark.createDataFrame([(i, [s >> 32 * k & 0xFFFFFFFF for k in range(4)]) for i, s in enumerate(sigs)], "k long, w array<long>")
    links, members = S.hamming_links(df, "k", "w", 128, 3, hot=16)
    least = {}
    for i, s in enumerate(sigs):
        least.setdefault(s, i)
    assert {(r["k"], r["u"]) for r in members.collect()} == {(i, least[s]) for i, s in enumerate(sigs)}
    u = sorted((k, s) for s, k in least.items())
    want = {(a, b, (x ^ y).bit_count()) for a, x in u for b, y in u if a < b and (x ^ y).bit_count() <= 3}
    assert {tuple(r) for r in links.collect()} == want and len(want) >= 50


def test_blocks_bound_what_meets_in_a_task(spark):
    a = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("a")).union(spark.range(5).select(F.lit(2), "id"))
    b = spark.range(700).select(F.lit(1).alias("k"), F.col("id").alias("b")).union(spark.range(5).select(F.lit(2), "id"))
    met = S.blocked(a, b, ["k"], 50)
    assert met.groupBy("k").count().orderBy("k").collect() == [(1, 700_000), (2, 25)] and met.distinct().count() == 700_025
    keys = met.groupBy("k", F.pmod(F.xxhash64("a"), F.lit(20)), F.pmod(F.xxhash64("b"), F.lit(14))).count()
    assert keys.agg(F.max("count")).first()[0] < 100 * 100


@pytest.mark.parametrize("hot", [4, 1024])
def test_places_in_one_cell(spark, hot):
    rng = random.Random(7)
    rows = [(i, "a", rng.uniform(0.01, 0.9), rng.uniform(-0.4, -0.1)) for i in range(120)] + [(200 + i, "a", 0.5, -0.25) for i in range(30)] + [(300 + i, "b", rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)]
    rows += [(400, "a", 1.5, -0.25), (401, "a", -0.5, -0.25), (402, "a", None, 0.0)]
    df = spark.createDataFrame(rows, "k long, g string, x double, y double")
    got = {(r["a"], r["b"]) for r in S.distance_pairs(df, "k", "x", "y", 1.0, ["g"], hot).collect()}
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and None not in (p[2], q[2]) and np.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) <= 1.0}
    assert got == want and (200, 400) in want


def test_a_long_chain_of_conflicts(spark, monkeypatch):
    rounds = []
    plain = S.durable
    monkeypatch.setattr(S, "durable", lambda df: rounds.append(1) or plain(df))
    n = 5000
    nodes = spark.range(n + 3000).selectExpr("id as k", "id as p")
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b").union(spark.range(1500).selectExpr(f"{n} + 2 * id as a", f"{n} + 2 * id + 1 as b"))
    alive = S.suppress(nodes, edges, "k", "p", local=5500)  # more conflicts in all than a task takes
    assert alive.where("k % 2 = 1").count() == 0 and alive.count() == n // 2 + 1500
    assert len(rounds) < 4 * 20  # four tables a round
    few = S.suppress(nodes.where("k < 14"), edges.where("b < 14"), "k", "p", local=3)  # a component too large for a task
    assert sorted(r["k"] for r in few.collect()) == list(range(0, 14, 2))


def test_zip_keeps_margins_and_exchange_forbids(spark):
    left = spark.createDataFrame([("x", 30), ("y", 50), ("z", 20)], "a string, n long")
    right = spark.createDataFrame([("p", 60), ("q", 40), ("never", 0)], "b string, n long")
    zipped = X.zip_schedule({"a": (left, "n"), "b": (right, "n")}, 5)
    pairs = Counter((r["a"], r["b"]) for r in zipped.collect())
    assert sum(v for (a, _), v in pairs.items() if a == "x") == 30 and sum(v for (_, b), v in pairs.items() if b == "q") == 40
    assert [r["slot"] for r in zipped.orderBy("slot").collect()] == list(range(1, 101)) and len(pairs) == 6
    assert zipped.orderBy("slot").collect() == X.zip_schedule({"a": (left, "n"), "b": (right, "n")}, 5).orderBy("slot").collect()
    done = X.exchange(zipped, "slot", "b", ~((F.col("a") == "x") & (F.col("b") == "q")), 6)
    after = Counter((r["a"], r["b"]) for r in done.collect())
    assert ("x", "q") not in after and sum(v for (_, b), v in after.items() if b == "q") == 40 and sum(v for (a, _), v in after.items() if a == "x") == 30
    with pytest.raises(ValueError, match="different lengths"):
        X.zip_schedule({"a": (left, "n"), "b": (right.where("n < 60"), "n")}, 5)
    with pytest.raises(ValueError, match="no exchange"):
        X.exchange(zipped, "slot", "b", F.col("b") == "p", 6, rounds=2)


def test_bottom_k_is_that_of_all(spark):
    rows = [("ab"[i % 7 == 0], i, hashlib.sha256(str(i % 900).encode()).hexdigest()) for i in range(1000)] + [("c", 5, "0")]
    df = spark.createDataFrame(rows, "g string, k long, d string").repartition(9)
    got = W.bottom_k(df, ["g"], "d", ["k"], 40, fan=4)
    want = {(g, k, n) for g in "abc" for n, (_, k) in enumerate(sorted((d, k) for h, k, d in rows if h == g)[:40], 1)}
    assert {(r["g"], r["k"], r["rank"]) for r in got.collect()} == want
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 3


def test_trees_name_what_differs(spark):
    rows = [(f"dir/{i:x}/f.txt", f"{i * 7:x}", i) for i in range(3000)]
    a = spark.createDataFrame(rows, "path string, h string, n long")
    b = spark.createDataFrame([r for r in rows[:-1] if r[0] != rows[5][0]] + [(rows[5][0], "new", 5), ("dir/added", "x", 1)], a.schema)
    trees = [I.fingerprint_tree(x, "path", "h", "n", 8).cache() for x in (a, b)]
    assert trees[0].where("level = 0").first()["files"] == 3000 and trees[0].agg(F.max("level")).first()[0] == 3
    assert trees[0].where("level = 0").first()["digest"] != trees[1].where("level = 0").first()["digest"]
    got = I.tree_difference(a, b, *trees, "path", "h", "n")
    assert {tuple(r) for r in got.collect()} == {(rows[5][0], "CHANGED"), ("dir/added", "ADDED"), (rows[-1][0], "MISSING")}
    assert I.tree_difference(a, a.repartition(3), trees[0], I.fingerprint_tree(a.repartition(5), "path", "h", "n", 8), "path", "h", "n").count() == 0
    one = [rows[17][0]]
    off = {(r["level"], r["prefix"]) for r in trees[0].join(I.fingerprint_tree(a.withColumn("h", F.when(F.col("path").isin(one), "z").otherwise(F.col("h"))), "path", "h", "n", 8).withColumnRenamed("digest", "d2"), ["level", "prefix"]).where("digest <> d2").collect()}
    p = hashlib.sha256(one[0].encode()).hexdigest()
    assert off == {(d, p[:d]) for d in range(4)}  # one branch


def test_covariance_of_large_means(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    df = spark.createDataFrame([(0, [float(v) for v in r + 1e8]) for r in x] + [(1, [float(v) for v in r]) for r in x], "p int, v array<double>")
    got = {(r["p"], r["i"], r["j"]): r["cov"] for r in A.covariance(df, "p", "v").collect()}
    want = np.cov(x.T)
    assert all(got[p, i, j] == pytest.approx(want[i, j], abs=1e-6) for p in (0, 1) for i in range(3) for j in range(i, 3))
    far = {(r["a"], r["b"]): r["distance"] for r in A.frechet_distances(df, "p", "v").collect()}
    assert far[0, 1] == pytest.approx(3e16, rel=1e-6)


def test_a_tree_of_few_levels_is_one_leaf_beyond_them(spark):
    rows = [(f"d/{i:x}", f"{i % 3}", i % 90) for i in [*range(700), 5, 5]]
    df = spark.createDataFrame(rows, "k string, d string, n long").repartition(5)
    lines = sorted(f"{k}\t{n}\t{d}" for k, d, n in rows)
    want = "\n".join(lines)
    for _ in range(3):
        want = hashlib.sha256(want.encode()).hexdigest()
    assert I.tree_fingerprint(df, "k", "d", "n", 2, 2).first() == (want, 702, sum(r[2] for r in rows))
    assert I.tree_fingerprint(df, "k", "d", "n", 3, 2).first() == I.tree_fingerprint(df, "k", "d", "n", 3).first()
    assert I.sorted_digest(df.select(F.concat_ws("\t", "k", "n", "d").alias("line")), block=40).first()[0] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(2))
def test_places_are_taken_without_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "distance_pairs", None)
    monkeypatch.setattr(S, "ROUND", 5)
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.random() * 3, rng.random() * 3, round(rng.random(), 2)) for i in range(150)]
    rows += [(200 + i, "c", 1.0, 1.0, 0.5) for i in range(30)] + [(300, "a", None, 1.0, 9.0), (301, "a", float("nan"), 1.0, 8.0), (302, None, 1.0, 1.0, 1.0), (303, None, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k long, g string, x double, y double, v double").repartition(3)
    want = set()
    for g in ("a", "b", "c", None):
        kept = []
        for k, _, x, y, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[4], r[0])):
            if len(kept) < 7 and all(g is None or None in (x, u) or not math.dist((x, y), (u, v)) <= 0.6 for u, v in kept):
                kept.append((x, y))
                want.add((k, g, len(kept)))
    assert {(r["k"], r["g"], r["rank"]) for r in S.suppress_positions(df, "k", ["g"], "x", "y", "v", 0.6, 7).collect()} == want


def test_diverse_rows_are_taken_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "hamming_links", None)
    monkeypatch.setattr(S, "ROUND", 4)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(9)]
    rows = [(i, "ab"[i % 2], base[rng.randrange(9)] ^ (1 << rng.randrange(64)), round(rng.random(), 1)) for i in range(90)]
    df = spark.createDataFrame([(i, g, [s & 0xFFFFFFFF, s >> 32], v) for i, g, s, v in rows] + [(99, "a", None, 2.0)], "k int, g string, w array<long>, v double")
    want, used = set(), []
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    for phase, pool, most, limit in (("quota", [r for r in order if r[1] == "b"], 5, 3), ("quota", [r for r in order if r[1] == "a"], 50, 3), ("fill", order, 40, 1)):
        n = len(used) if phase == "fill" else 0
        for r in pool:
            if n < most and all((r[2] ^ u).bit_count() > limit for u in used):
                used.append(r[2])
                want.add((r[0], r[1], phase))
                n += 1
    got = S.diverse_select(df, "k", "g", "w", "v", {"b": 5, "a": 50}, 40, 64, 3, 1)
    assert {tuple(r) for r in got.collect()} == want and dict(got.dtypes) == {"k": "int", "g": "string", "phase": "string"}
    assert S.diverse_select(df.limit(0), "k", "g", "w", "v", {"b": 5}, 40, 64, 3, 1).collect() == []


def test_links_are_counted_in_units(spark):
    rng = random.Random(12)
    sigs = [(rng.getrandbits(80) << 48) if i % 2 else rng.getrandbits(128) for i in range(150)]
    sigs += [s ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for s in sigs[:70]] + [sigs[1]] * 60
    df = spark.createDataFrame([(f"{i:03}", [s >> 32 * k & 0xFFFFFFFF for k in range(4)]) for i, s in enumerate(sigs)] + [("none", None)], "k string, w array<long>")
    least = {s: f"{i:03}" for i, s in reversed(list(enumerate(sigs)))}
    n = {x: sum(x != y and (x ^ y).bit_count() <= 5 for y in least) for x in least}
    for hot in (8, 1000):
        got = {tuple(r) for r in S.hamming_classes(df, "k", "w", 128, 5, hot=hot).collect()}
        assert got == {(f"{i:03}", least[s], n[s]) for i, s in enumerate(sigs)} and sum(n.values()) > 100


def test_pairs_of_signatures_are_told_once_and_not_shuffled(spark):
    rng = random.Random(12)
    sigs = [(rng.getrandbits(80) << 48) if i % 2 else rng.getrandbits(128) for i in range(150)]
    sigs += [s ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for s in sigs[:70]] + [sigs[1]] * 60
    df = spark.createDataFrame([(f"{i:03}", [s >> 32 * k & 0xFFFFFFFF for k in range(4)]) for i, s in enumerate(sigs)] + [("none", None)], "k string, w array<long>")
    every = [(f"{a:03}", f"{b:03}", (x ^ y).bit_count()) for a, x in enumerate(sigs) for b, y in enumerate(sigs) if a < b and (x ^ y).bit_count() <= 5]
    for hot in (8, 1000):
        pairs = S.hamming_pairs(df, "k", "w", 128, 5, hot=hot)
        assert sorted(tuple(r) for r in pairs.collect()) == sorted(every) and len(every) > 1800
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("MapInArrow") < plan.index("Exchange")


def test_signatures_with_fewer_bits_than_cuts(spark):
    df = spark.createDataFrame([(i, [i]) for i in range(64)], "k long, w array<long>")
    want = sorted((a, b, (a ^ b).bit_count()) for a in range(64) for b in range(a + 1, 64) if (a ^ b).bit_count() <= 4)
    assert sorted(tuple(r) for r in S.hamming_pairs(df, "k", "w", 32, 4, hot=3).collect()) == want
