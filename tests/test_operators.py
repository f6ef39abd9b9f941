"""Golden cases, sequential models and error cases of the core operators."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siftwell.functions import columns as C
from siftwell.functions import masks as M
from siftwell.operators import aggregates as A
from siftwell.operators import integrity as I
from siftwell.operators import selection as X
from siftwell.operators import similarity as S
from siftwell.operators import windows as W
from siftwell.sources import scans, sinks


def test_average_precision_golden(spark):
    iou, conf = [1.0, 0.75, 0.5, 0.25], [0.9, 0.8, 0.7, 0.6]
    df = spark.createDataFrame([("g", i, c, k) for k, (i, c) in enumerate(zip(iou, conf))], "g string, iou double, conf double, k int")
    targets = spark.createDataFrame([("g", 4)], "g string, n_targets int")
    thresholds = [0.5 + 0.05 * k for k in range(10)]
    out = A.map_summary(A.mean_ap(df, ["g"], targets, thresholds, "iou", "conf", "k"), ["g"]).first()
    assert out["map50"] == pytest.approx(0.75) and out["map50_95"] == pytest.approx(0.425)
    rates = A.prf(df.withColumn("t", F.lit(True)), ["g"], F.col("k") < 4, F.col("iou") >= 0.5).first()
    assert rates["recall"] == 0.75 and rates["precision"] == 1.0


def test_task_score_golden(spark):
    rows = [(0.0, 0.0), (1.0, 1.0), (float("nan"), 0.5), (float("inf"), 0.5), (-1.0, 0.5), (0.5, 2.0)]
    df = spark.createDataFrame(rows, "i double, c double").select(C.task_score(F.col("i"), F.col("c")).alias("s"))
    assert [r["s"] for r in df.collect()] == [2.0, 0.0, None, None, None, None]


def test_unsafe_paths(spark):
    paths = ["../outside.jpg", "D:/outside.jpg", "/root.jpg", "a//b", "", "a/./b", "a/b.jpg", "a\\..\\b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", C.is_safe_path(F.col("p")).alias("ok"))
    assert {r["p"] for r in df.collect() if r["ok"]} == {"a/b.jpg"}


def test_minmax_of_equal_values_is_half(spark):
    df = spark.createDataFrame([(1, 3.0, "a"), (2, 3.0, "a"), (3, 5.0, "b"), (4, 7.0, "b")], "k int, x double, g string")
    out = {r["k"]: r["x_norm"] for r in W.minmax(df, {"x": True}, ["g"]).collect()}
    assert out == {1: 0.5, 2: 0.5, 3: 1.0, 4: 0.0}


def shares(weights, n):
    total = sum(weights.values())
    exact = {k: n * w / total for k, w in weights.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (round(exact[k] - out[k], 9), k), reverse=True)[: n - sum(out.values())]:
        out[k] += 1
    return out


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 50), min_size=1), st.integers(0, 200))
def test_allocation(spark, weights, n):
    df = spark.createDataFrame(list(weights.items()), "k string, w long")
    assert {r["k"]: r["quota"] for r in X.allocate(df, "k", "w", n).collect()} == shares(weights, n)


def greedy(n, edges):
    taken = []
    for i in range(n):
        if not any((i, j) in edges or (j, i) in edges for j in taken):
            taken.append(i)
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_suppression_equals_greedy(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.07}
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "k int, p int")
    e = spark.createDataFrame([*edges] or [], "a int, b int")
    assert sorted(r["k"] for r in S.suppress(nodes, e, "k", "p").collect()) == greedy(n, edges)


def test_hamming_pairs_are_complete(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    sigs = [base[i % 12] ^ sum(1 << rng.randrange(64) for _ in range(i % 5)) & (1 << 64) - 1 for i in range(60)]
    df = spark.createDataFrame([(i, [s & 0xFFFFFFFF, s >> 32]) for i, s in enumerate(sigs)], "k int, w array<long>")
    got = {(r["a"], r["b"], r["distance"]) for r in S.hamming_pairs(df, "k", "w", 64, 6).collect()}
    want = {(a, b, (sigs[a] ^ sigs[b]).bit_count()) for a in range(60) for b in range(a + 1, 60) if (sigs[a] ^ sigs[b]).bit_count() <= 6}
    assert got == want and want


def test_diverse_selection_equals_sequential(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(10)]
    rows = [(i, "ab"[i % 2], base[rng.randrange(10)] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), round(rng.random(), 6)) for i in range(50)]
    df = spark.createDataFrame([(i, g, [s & 0xFFFFFFFF, s >> 32], v) for i, g, s, v in rows], "k int, g string, w array<long>, v double")
    got = {(r["k"], r["phase"]) for r in S.diverse_select(df, "k", "g", "w", "v", {"a": 6, "b": 6}, 30, 64, 3, 1).collect()}
    used, want = [], set()
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    for g in "ab":
        n = 0
        for r in order:
            if r[1] == g and n < 6 and all((r[2] ^ u).bit_count() > 3 for u in used):
                used.append(r[2])
                want.add((r[0], "quota"))
                n += 1
    done = {k for k, _ in want}
    for r in order:
        if len(used) < 30 and r[0] not in done and all((r[2] ^ u).bit_count() > 1 for u in used):
            used.append(r[2])
            want.add((r[0], "fill"))
    assert got == want


def test_graph_problems(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "x"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "d")], "node string, dependency string")
    got = {(r["node"], r["level"], r["problem"]) for r in I.check_graph(nodes, edges).collect()}
    assert got == {("a", 0, None), ("b", 1, None), ("c", 2, None), ("f", 0, None), ("d", None, "cycle"), ("e", None, "cycle"), ("g", None, "cycle"), ("c", None, "missing"), ("f", None, "self_loop")}
    down = {r["node"] for r in I.downstream(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert down == {"a", "b", "c"}


def test_polygons(spark):
    lines = ["0 0 0 1 0 1 1 0 1", "1 0.1 0.1 0.2 0.1 0.2 0.2", "", "0 0 0 1 1", "x 0 0 1 0 1 1", "0 0 0 1 0 1 y", "0 0 0 1 0 1 1.5", "-1 0 0 1 0 1 1"]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    got = {r["k"]: r["reason"] for r in M.parse_polygons(df, "line").collect()}
    assert got == {0: "", 1: "", 2: "empty", 3: "field_count", 4: "class", 5: "non_numeric", 6: "out_of_range", 7: "class"}
    area = [round(r["a"], 9) for r in M.parse_polygons(df, "line", "skip").select(M.polygon_area("points").alias("a")).collect()]
    assert area == [1.0, 0.005]
    with pytest.raises(Exception, match="bad polygon line"):
        M.parse_polygons(df, "line", "fail").collect()


def test_masks(spark):
    rng = np.random.default_rng(2)
    bits = rng.random((20, 64)) < 0.3
    bits[0] = False
    df = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(bits)], "k int, b array<boolean>").withColumn("w", M.pack_bits(F.col("b"), 64))
    assert df.where(M.unpack_bits(F.col("w"), 64) != F.col("b")).count() == 0
    pairs = df.crossJoin(df.select(F.col("w").alias("v"), F.col("k").alias("j"))).select("k", "j", M.mask_iou(F.col("w"), F.col("v"), 1.0).alias("iou"))
    for r in pairs.collect():
        a, b = bits[r["k"]], bits[r["j"]]
        assert r["iou"] == pytest.approx((a & b).sum() / (a | b).sum() if (a | b).any() else 1.0)
    stats = {r["k"]: r for r in M.mask_stats(df, "w", 8, 8).collect()}
    assert stats[0]["area"] == 0 and stats[0]["box_x0"] is None
    ys, xs = np.nonzero(bits[1].reshape(8, 8))
    assert (stats[1]["box_x0"], stats[1]["box_y1"]) == (xs.min(), ys.max())


def test_frechet_and_covariance(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=(40, 16)) + k for k in range(3)]
    df = spark.createDataFrame([(k, v.tolist()) for k in range(3) for v in x[k]], "p int, v array<double>")
    cov = np.zeros((16, 16))
    for r in A.covariance(df.where("p = 1"), "p", "v").collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    assert np.allclose(cov, np.cov(x[1].T))
    got = {(r["a"], r["b"]): r for r in A.frechet_distances(df, "p", "v").collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for (a, b), r in got.items():
        c, d = np.cov(x[a].T), np.cov(x[b].T)
        roots = np.linalg.eigvals(c @ d)
        want = ((x[a].mean(0) - x[b].mean(0)) ** 2).sum() + np.trace(c) + np.trace(d) - 2 * np.sqrt(np.maximum(roots.real, 0)).sum()
        assert (r["n_a"], r["n_b"]) == (40, 40) and r["distance"] == pytest.approx(want)


def test_radial_profile_is_centred(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3, 4, 4))
    df = spark.createDataFrame([(0, v.ravel().tolist()) for v in x], "p int, v array<double>")
    got = {r["bin"]: r["power"] for r in M.radial_profile(df, "p", "v", 4, 3).collect()}
    want = []
    for v in x:
        power = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(v))) ** 2)
        far = np.array([[np.hypot(i - 1.5, j - 1.5) for j in range(4)] for i in range(4)])
        edges = np.linspace(0, far.max(), 4)
        want.append([power[(far >= a) & (far < b)].mean() if ((far >= a) & (far < b)).any() else 0.0 for a, b in zip(edges, edges[1:])])
    assert [got[k] for k in range(3)] == pytest.approx(np.mean(want, 0).tolist())


def plain_sobel(v):
    n = len(v)
    at = lambda i: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    g = np.zeros_like(v)
    for r in range(n):
        for c in range(n):
            cell = lambda i, j: v[at(r + i), at(c + j)]  # noqa: E731, B023
            gx = sum(w * (cell(i, 1) - cell(i, -1)) for i, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (cell(1, j) - cell(-1, j)) for j, w in ((-1, 1), (0, 2), (1, 1)))
            g[r, c] = np.hypot(gx, gy)
    return g


def test_raster_measures(spark):
    rng = np.random.default_rng(6)
    x, masks = rng.uniform(0, 256, size=(4, 6, 6)), rng.random((4, 6, 6)) < 0.3
    masks[3] = False
    df = spark.createDataFrame([(k, v.ravel().tolist(), m.ravel().tolist()) for k, (v, m) in enumerate(zip(x, masks))], "k int, v array<double>, m array<boolean>").withColumn("p", F.lit("a"))
    got = {r["k"]: r for r in M.raster_features(df, "k", "v", 6, mask="m").collect()}
    values = {}
    for r in M.gradient_values(df, "k", "p", "v", 6, "m").collect():
        values.setdefault(r["k"], {})[r["pos"]] = r["value"]
    for k, (v, m) in enumerate(zip(x, masks)):
        g = plain_sobel(v)
        assert got[k]["edge_share"] == pytest.approx((g > 28).mean())
        n = np.bincount((v // 4).astype(int).ravel(), minlength=64) / 36
        assert got[k]["entropy"] == pytest.approx(-sum(p * np.log2(p) for p in n if p))
        cells = [np.array([c.mean(), c.std()]) for c in (v[i : i + 2, j : j + 2] for i in (0, 2, 4) for j in (0, 2, 4))]
        far = np.mean([np.linalg.norm(cells[i] - cells[j]) for i in range(9) for j in range(i)])
        assert got[k]["self_similarity"] == pytest.approx(max(0, 1 - far / 55))
        assert got[k]["contrast"] == (pytest.approx(abs(v[m].mean() - v[~m].mean())) if m.any() else None)
        want = {i: g.ravel()[i] for i in (np.flatnonzero(m) if m.any() else range(36))}
        assert values[k] == pytest.approx(want)
    few = M.sample_values(M.gradient_values(df, "k", "p", "v", 6), "p", ["k", "pos"], 10, 3)
    assert few.count() == 10


def test_string_keys(spark):
    rows = [("b.jpg", "g1", 2.0), ("a.jpg", "g1", 2.0), ("c.jpg", "g1", 1.0), ("d.jpg", None, 3.0), ("e.jpg", "g2", None), ("f.jpg", "g2", 0.5)]
    df = spark.createDataFrame(rows, "name string, g string, score double")
    assert {r["name"] for r in W.keep_best(df, "g", "score", "name").where("removed").collect()} == {"b.jpg", "c.jpg", "e.jpg"}
    assert {r["g"]: r["best_pos"] for r in W.best_of(df, "g", "score", "name").collect()}["g1"] == "a.jpg"
    tied = spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0), ("s", "a", 1.0)], "s string, c string, x double")
    assert [r["c"] for r in W.select_candidate(tied, "s", "c", ["x"], {"x": 1.0}, ["full"], 1).collect()] == ["a"]
    docs = spark.createDataFrame([(f"f{k:02d}.jpg", "snow" if k % 2 else "road", f"g{k % 9}", float(k % 7)) for k in range(40)], "name string, env string, grp string, size double")
    log = X.select_hard(docs, "name", "env", "grp", {"size": (1.0, True)}, 12).collect()
    assert sum(r["action"] != "promoted" for r in log) == 12
    for env in ("snow", "road"):
        ranked = sorted((r for r in log if r["env"] == env and r["action"] != "removed"), key=lambda r: (-r["score"], r["name"]))
        assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))


def test_selections_golden(spark):
    rows = [(str(k), True, k / 10, 2 - 2 * k / 10) for k in range(6)]
    make = lambda r: spark.createDataFrame(r, "id string, valid boolean, iou double, score double")
    pick = lambda r: W.compare_selections(make(r), 3, 416, "id", "score", F.col("valid"), C.task_score(F.col("iou"), F.col("iou")))
    got = {}
    for r in pick(rows).collect():
        got.setdefault(r["method"], {})[r["rank"]] = r["id"]
    assert got["task"] == {1: "0", 2: "1", 3: "2"} and len(got["random"]) == 3
    assert sorted(map(tuple, pick(rows[::-1]).collect())) == sorted(map(tuple, pick(rows).collect()))
    for bad in (rows + rows[:1], [(a, False, b, c) for a, _, b, c in rows], [(a, v, b, -1.0) for a, v, b, _ in rows], rows[:2]):
        with pytest.raises(ValueError):
            pick(bad)


def test_digests_tell_values_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert I.row_digest(df, ["x", "y"]).select("row_digest").distinct().count() == 4
    pairs = spark.createDataFrame([(1, "a|b", "c"), (1, "a", "b|c"), (2, "q", "r"), (2, "q", "r")], "g int, x string, y string")
    assert {r["g"]: r["equal"] for r in A.all_equal(pairs, ["g"], ["x", "y"]).collect()} == {1: False, 2: True}


def test_screen_reasons(spark):
    rows = [(1, "x github_pat_" + "a1B2" * 14, "a.txt"), (2, "sk-proj-" + "Ab9_" * 10, "b/model.ckpt"), (3, "fine", "c/.env.local"), (4, "xoxb-" + "1" * 19, "d.MP4"), (5, "AKIA" + "A1" * 8, None)]
    got = C.screen_text(spark.createDataFrame(rows, "k int, t string, p string"), "k", "t", C.SCREEN_PATTERNS, path="p").collect()
    assert {(r["k"], r["reason"]) for r in got} == {(1, "github_token"), (2, "openai_key"), (2, "denied_format"), (3, "denied_format"), (4, "denied_format"), (5, "aws_access_id")}


def test_rendered_bundles(spark):
    square = "0 0.1 0.1 0.9 0.1 0.9 0.9"
    meta = {"sample_id": "s", "selection": "x"}
    rows = [
        (1, 4, 4, 4, [0, 255], square, meta, []), (2, 4, 4, 5, [0, 0], square, meta, ["image_mask_size_mismatch", "mask_empty"]),
        (3, 4, 4, 4, [0, 7], square + "\n1 0 0 1 1 0 1", meta, ["mask_not_binary", "polygon_invalid_class"]), (4, 4, 4, 4, [255], "  ", {"sample_id": "s"}, ["metadata_missing:selection", "polygon_empty"]),
        (5, 4, 4, 4, [255], "0 0.1 0.1 0.9 0.1 0.9", None, ["metadata_missing:sample_id,selection", "polygon_invalid_field_count"]), (6, 4, 4, 4, None, "0 0.1 x 0.9 0.1 0.9 0.9", meta, ["mask_empty", "mask_not_binary", "polygon_non_numeric"]),
        (7, 4, 4, 4, [255], "0 0.1 0.1 1.9 0.1 0.9 0.9\n1 0 0", meta, ["polygon_coordinate_out_of_range"]),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], "k int, w int, h int, mw int, m array<int>, p string, meta map<string,string>")
    reasons = M.rendered_reasons((F.col("w"), F.col("h")), (F.col("mw"), F.col("h")), F.col("m"), F.col("p"), F.col("meta"), ["selection", "sample_id"])
    assert {r["k"]: r["r"] for r in df.select("k", reasons.alias("r")).collect()} == {r[0]: r[-1] for r in rows}


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [(g, None if rng.random() < 0.1 else rng.choice([float(rng.randrange(9)), rng.random() * 1e6])) for g in "ab" for _ in range(rng.randrange(50, 90))] + [("c", 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in A.describe_exact(df, "x", ["g"]).collect()}
    late = {r["g"]: r for r in A.latency_quantiles(df, ["g"], "x").collect()}
    for g in "abcd":
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            assert [got[g][c] for c in ("q1", "median", "q3")] == pytest.approx(np.percentile(v, [25, 50, 75]).tolist())
            assert late[g]["p95"] == v[int(np.ceil(0.95 * len(v))) - 1] and late[g]["n"] == len(v)
        else:
            assert got[g]["q1"] is None and late[g]["p95"] is None


def test_fingerprint_levels(spark):
    rows = [(k * 37 % 5000, f"{k:x}", k) for k in range(900)]
    df = spark.createDataFrame(rows, "k long, d string, n long")
    one = I.tree_fingerprint(df, "k", "d", "n", 8).first()
    assert I.tree_fingerprint(df.repartition(7), "k", "d", "n", 8).first() == one and (one["files"], one["bytes"]) == (900, sum(range(900)))
    assert I.tree_fingerprint(df.where("k <> 37").union(spark.createDataFrame([(37, "zz", 1)], df.schema)), "k", "d", "n", 8).first()["fingerprint"] != one["fingerprint"]


def test_verify_summary_finds_changes(spark):
    raw = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "e string, m double")
    good = A.summarise(raw, ["e"], ["m"])
    assert A.verify_summary(raw, good, ["e"], ["m"]).count() == 0
    assert {r["sample_sd"] for r in good.where("e = 'b'").collect()} == {None}
    bad = good.withColumn("mean", F.col("mean") + 1e-6)
    assert {r["reason"] for r in A.verify_summary(raw, bad, ["e"], ["m"]).collect()} == {"mean"}


def test_write_once_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5, None), (1, 1 / 3, "x")], "k int, v double, s string")
    path = str(tmp_path / "once")
    assert sinks.write_once(df, path) and not sinks.write_once(df.orderBy("k").repartition(3), path)
    with pytest.raises(FileExistsError):
        sinks.write_once(df.where("k = 1"), path)
    sinks.write_csv(df, str(tmp_path / "csv"), 4, ["k"])
    schema = StructType([StructField("k", IntegerType()), StructField("v", StringType()), StructField("s", StringType())])
    back = scans.read_table_csv(spark, str(tmp_path / "csv"), schema)
    assert [tuple(r) for r in back.orderBy("k").collect()] == [(1, "0.3333", "x"), (2, "0.5000", None)]
    with pytest.raises(ValueError):
        scans.read_table_csv(spark, str(tmp_path / "csv"), StructType(schema.fields[:2]))
    assert scans.read_table_csv(spark, str(tmp_path / "csv"), StructType(schema.fields[:2]), exact=False).count() == 2


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([9, 8, 7]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_scans(spark, tmp_path):
    (tmp_path / "img/snow").mkdir(parents=True)
    (tmp_path / "img/snow/A.PNG").write_bytes(png(3, 2))
    (tmp_path / "img/bad.jpg").write_bytes(b"no image")
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.txt").write_text("0 1 2\n\n  \n1 2 3\n")
    (tmp_path / "m.jsonl").write_text('{"id": "a", "rank": 1}\n\n{"id": "b", "rank": 2}\n')
    files = {(r["stem"], r["extension"], r["folder"]) for r in scans.scan_files(spark, str(tmp_path / "img"), [".png"]).collect()}
    assert files == {("a", ".png", "snow")}
    good, bad = scans.scan_images(spark, str(tmp_path / "img"))
    assert [(r["width"], r["height"], bytes(r["data"][:3])) for r in good.collect()] == [(3, 2, bytes([7, 8, 9]))]
    assert [r["path"].rpartition("/")[2] for r in bad.collect()] == ["bad.jpg"]
    assert [(r["stem"], r["line"]) for r in scans.scan_labels(spark, str(tmp_path / "labels")).collect()] == [("a", "0 1 2"), ("a", "1 2 3")]
    schema = StructType([StructField("id", StringType()), StructField("rank", IntegerType())])
    assert [r["rank"] for r in scans.read_manifest(spark, str(tmp_path / "m.jsonl"), schema).orderBy("rank").collect()] == [1, 2]


def test_exact_split_counts(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") % 3).alias("g"))
    out = {r["split"]: r["n"] for r in X.stratified_split(df, "g", "k", {"train": 748, "val": 100, "test": 200}, 1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(out["test"] - 200) <= 1 and abs(out["val"] - 100) <= 1 and abs(out["train"] - 748) <= 2 and sum(out.values()) == 3000


def test_balanced_assignment(spark):
    slots = spark.range(600).select(F.col("id").alias("slot"), (F.col("id") % 150).alias("bg"), F.lit("e").alias("env"))
    objects = spark.range(40).select(F.col("id").alias("obj"), F.lit("e").alias("env"))
    got = X.assign_balanced(slots, objects, "env", "slot", "bg", "obj", 3).cache()
    uses = [r["n"] for r in got.groupBy("obj").agg(F.count("*").alias("n")).collect()]
    assert max(uses) - min(uses) <= 1 and got.count() == 600
    assert A.repeat_stats(got, "obj", "bg").first()["excess_pairs"] == 0
