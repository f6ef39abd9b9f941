"""The pipeline's stages: what each keeps, changes and returns."""

import gc
import random

import pytest

import corpus_pipeline as pipe
from siftwell.llm.simhash import fingerprint

from .conftest import make
from .test_parts import best_fit, plain_lines
from .test_scans import toxic_rows


@pytest.fixture(scope="module")
def sf_dir(spark, words, corpus, tmp_path_factory):
    rows, labels = toxic_rows(words)
    rng = random.Random(1)
    rows += [(1000 + i, t) for i, t in corpus]
    rows += [(5000 + i, " ".join(rng.choice(words) for _ in range(30)) + f" password={i:06d}abc1def") for i in range(20)]
    d = tmp_path_factory.mktemp("sf")
    make(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == pipe.COLUMNS
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in want if i >= 600 or i % 4}
    assert clean <= set(seen["toxicity"])
    assert len(set(seen["toxicity"]) - clean) < 10
    assert all(seen["toxicity"][i] == want[i] for i in seen["toxicity"])
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    brute = plain_lines(list(seen["toxicity"].items()))
    assert {i for i in brute if brute[i][1]} == {i for i in brute if seen["line_dedup"][i] != seen["toxicity"][i]}
    fps = {i: fingerprint((t or "").encode()) for i, t in seen["line_dedup"].items()}
    low, changed = {i: i for i in fps}, True
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    assert set(seen["near_dedup"]) == {i for i in fps if low[i] == i}
    assert set(seen["secrets"]) == set(seen["near_dedup"])
    for i, t in seen["secrets"].items():
        if i >= 5000:
            assert "password=" not in t and "<assign>" in t
        elif i >= 1000:
            assert t == seen["near_dedup"][i]
    lengths = [r["length"] for r in docs.collect()]
    assert docs.select("sequence_id").distinct().count() == best_fit(lengths, 1024)
    assert set(seen["secrets"]) == {r["doc_id"] for r in docs.collect()}


def test_run_gives_the_last_stage(spark, sf_dir):
    assert pipe.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_odd_rows(spark, sf_dir, words, tmp_path):
    """Null ids and texts, repeated ids with unlike texts, repeated rows, a very long text, and columns named as the stages' own."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    twice = prose(60)
    odd = [(None, prose(50)), (None, None), (7000, None), (7001, ""), (7002, prose(80)), (7002, prose(80)), (7003, prose(150_000)), (7004, twice), (7004, twice), (7005, f"{prose(40)} password=abc1def2{'x' * 9}")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(make(spark, odd))
    for name in ("h", "id", "line", "score", "root", "r", "node", "keys", "masked", "order", "packed", "gone", "rank", "size"):
        docs = docs.withColumn(name, docs["lang"])
    seen = {}
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r)[:2] for r in docs.where("doc_id is null or doc_id >= 7000").collect()]
        if name != "packing":
            assert docs.columns == pipe.COLUMNS
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(seen["toxicity"], key=key) == sorted(odd, key=key)
    texts = lambda name, i: sorted(t or "" for k, t in seen[name] if k == i)
    assert sorted(seen["line_dedup"], key=key) == sorted(odd, key=key)
    assert texts("near_dedup", 7002) == texts("toxicity", 7002) and texts("near_dedup", 7004) == [twice]
    assert texts("near_dedup", None) == texts("toxicity", None) and len(texts("near_dedup", 7003)) == 1
    assert sum(len(texts("near_dedup", i)) for i in (7000, 7001)) <= 1  # copies of each other and of other empty texts
    assert texts("secrets", 7005)[0].endswith("<assign>")
    pieces = [r for r in seen["packing"] if r[0] == 7003]
    assert len(pieces) > 100 and sorted(k for _, k in pieces) == list(range(len(pieces)))


def test_stages_on_an_empty_table(spark, sf_dir, tmp_path):
    docs = make(spark, [])
    for name, stage in pipe.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_near_dedup_links_by_fingerprint_and_by_shingles(spark, words):
    """Texts whose fingerprints are equal although their sets of shingles are not alike, and the other way round."""
    rng = random.Random(31)
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    chorus = " ".join(["over and out"] * 300)
    rows = [(k, f"{chorus} {' '.join(prose(20))}") for k in range(3)]
    assert len({fingerprint(t.encode()) for _, t in rows}) == 1
    w = prose(120)
    changed = [*w[:60], "another", *w[61:]]
    rows += [(10, " ".join(w)), (11, " ".join(changed)), (12, " ".join(prose(120)))]
    assert (fingerprint(rows[3][1].encode()) ^ fingerprint(rows[4][1].encode())).bit_count() > 2
    kept = pipe.keep_one_of_near(spark, make(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 10, 12]


def test_heap_is_handed_back(spark, empty, monkeypatch):
    """What earlier jobs made a heap grow to goes back to the system, before a stage begins."""
    jvm = spark.sparkContext._jvm
    held = jvm.java.nio.ByteBuffer.allocate(700 << 20)
    grown = jvm.java.lang.Runtime.getRuntime().totalMemory()
    del held
    gc.collect()
    pipe.shrink_heaps(spark)
    assert jvm.java.lang.Runtime.getRuntime().totalMemory() < grown - (300 << 20)
    called = []
    monkeypatch.setattr(pipe, "shrink_heaps", lambda spark: called.append(1) or 1 / 0)
    for _, stage in pipe.STAGES:
        with pytest.raises(ZeroDivisionError):
            stage(spark, empty, "/nowhere")
    assert len(called) == len(pipe.STAGES)
