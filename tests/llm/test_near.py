"""SimHash and embeddings against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipe
from siftwell.llm import near
from siftwell.llm import embeddings as emb
from siftwell.llm.embeddings import embedding_groups
from siftwell.llm.simhash import fingerprint, golay_keys, golay_tables, links, simhash_groups

from .conftest import make


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_golay_keys_are_complete():
    unit, errors = golay_tables()
    assert sorted({int((errors[s] >= 0).sum()) for s in range(2048)}) == [1, 6]
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3000)]
    other = [x ^ (1 << a) ^ (1 << b if a != b else 0) for x in base for a, b in [(rng.randrange(64), rng.randrange(64))]]
    k1, k2 = golay_keys(np.array(base, np.uint64)), golay_keys(np.array(other, np.uint64))
    assert all({*a[a >= 0].tolist()} & {*b[b >= 0].tolist()} for a, b in zip(k1, k2))


def test_groups_equal_brute_force(docs, corpus):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(docs).collect()}
    fp = {i: plain_fingerprint(t or "") for i, t in corpus}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    ids = sorted(fp)
    pairs = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert {i: c for i, (_, c) in got.items()} == roots(ids, pairs)
    assert len(pairs) > 5


def test_crowded_keys_link_through_balls(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = {center} | {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = [(r["a"], r["b"]) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert roots(signed, edges) == roots(signed, want)


def test_simhash_odd_tables(clashing, empty):
    assert simhash_groups(empty).count() == 0
    out = simhash_groups(clashing).collect()
    assert len(out) == 35
    assert {r["component_id"] for r in out if r["doc_id"] is None and r["fingerprint"] == "0" * 16} == {None}


def test_fingerprint_of_long_text():
    text = ("ab cd ef gh " * 50_000).encode()
    assert fingerprint(text) == plain_fingerprint("ab cd ef gh " * 500)


def embeddings(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in range(3):
        centers = rng.normal(size=(60, 32))
        for c in centers:
            for _ in range(rng.integers(1, 12)):
                rows.append((k, (c + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.13])).astype(np.float32).tolist(), label))
                k += 1
    odd = [(k, None, 0), (k + 1, [0.0] * 32, 0), (k + 2, [float("nan")] * 32, 0), (k + 3, [1.0] * 32, None), (k + 4, [1.0] * 32, None), (k + 5, [], 1), (k + 6, [1.0, None], 1), (k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1), (k + 9, [float("inf"), 1.0], 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), rows + [(k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1)], [o[0] for o in odd]


@pytest.mark.parametrize("sample", [8192, 64])  # the small one leaves most levels to the refinement
def test_embeddings_recall_and_exactness(spark, sample):
    df, good, odd = embeddings(spark)
    got = {r["vec_id"]: r for r in embedding_groups(df.withColumn("cid", df["label"]).withColumn("e", df["label"]), leaf=32, sample=sample).collect()}
    assert len(got) == df.count()
    want = {}
    links_ = []
    for i, (a, x, l) in enumerate(good):
        for b, y, m in good[:i]:
            if l == m and len(x) == len(y):
                x_, y_ = np.array(x, float), np.array(y, float)
                if x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= 0.98:
                    links_.append((a, b))
                    want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    found = sum(r["n_links"] for r in got.values())
    assert all(r["n_links"] <= want.get(v, 0) for v, r in got.items())
    assert found >= 0.9 * 2 * len(links_) > 0
    low = roots([g[0] for g in good], links_)
    same = sum(got[v]["component_id"] == c for v, c in low.items())
    assert same >= 0.95 * len(low)
    for v in odd:
        if got[v]["n_links"] == 0:
            assert got[v]["component_id"] == v and got[v]["kept"]
    assert got[odd[7]]["n_links"] == 1


def test_embeddings_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK", 700)
    rng = np.random.default_rng(6)
    c = rng.normal(size=16)
    rows = [(i, (c + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(2500)] + [(5000 + i, c.tolist(), 1) for i in range(40)]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["n_links"] for r in got} == {2539}
    assert {r["component_id"] for r in got} == {0}
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_embeddings_of_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.2], [0.0, 1.0, 0.1]
    rows = [(1, a, 0), (1, b, 0), (2, b, 0), (3, [x * 2 for x in b], 0), (4, b, 1), (4, b, 1)]
    got = sorted(tuple(r) for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_roots(texts):
    """Number of the first text of each one's component, by all pairs of Jaccard similarity 0.8 or more."""
    sets = [plain_shingles(t or "") for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]


def near_texts(words):
    rng = random.Random(12)
    out = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(60, 260))]
        out.append(" ".join(w))
        for k in range(3):  # one to a twentieth of the words changed
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 20))):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
    return out + [out[0].upper(), "", None, " \n", "one", "One", "one two", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("paired", [64, 2])
def test_near_groups_equal_brute_force(spark, words, paired, monkeypatch):
    monkeypatch.setattr(near.near_nodes, "__defaults__", (near.WORDS, near.ALIKE, paired))
    texts = near_texts(words)
    want = plain_roots(texts)
    got = near.near_groups(make(spark, list(enumerate(texts)))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    first = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        first.setdefault(r["root"], r["doc_id"])
    assert {r["doc_id"]: first[r["root"]] for r in got} == dict(enumerate(want))
    assert 60 < len(set(want)) < 200


def test_band_recall_of_pairs_just_alike():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(2000)]
    other = [np.sort(np.append(s[:178], rng.integers(0, 1 << 63, 22).astype(np.uint64))) for s in sets]  # 178 / 222 = 0.802
    keys = [near.band_keys(np.concatenate(x), np.arange(0, 400_000, 200), near.BANDS, near.DEPTH) for x in (sets, other)]
    share = (keys[0] == keys[1]).any(1).mean()
    print("recall of pairs at 0.802:", share)
    assert share >= 0.998


def test_pipeline_drops_near_copies_that_simhash_keeps(spark, words):
    texts = near_texts(words)[:240]
    docs = make(spark, list(enumerate(texts)))
    kept = {r["doc_id"] for r in pipe.keep_one_of_near(spark, docs, "").collect()}
    assert kept == set(plain_roots(texts))


def test_pipeline_keeps_unlike_texts_of_one_id(spark, words):
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (3, c), (3, c), (4, c), (5, None), (None, a), (None, a)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in pipe.keep_one_of_near(spark, make(spark, rows), "").collect())
    assert kept == sorted([(1, a), (2, b), (3, c), (5, ""), (0, a), (0, a)])
    assert pipe.keep_one_of_near(spark, make(spark, []), "").columns == pipe.COLUMNS


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is written meanwhile, before it runs; in these tests all tables are small enough to be broadcast."""
    from siftwell.llm import common, graph, simhash

    seen = []

    def recorded(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return common.saved(df)

    for module in (graph, simhash, near, pipe):
        monkeypatch.setattr(module, "saved", recorded)
    return seen


def test_groups_broadcast_no_table(docs, plans):
    """Tables that grow with the documents are never collected in the driver to be broadcast."""
    last = simhash_groups(docs)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and "SortMergeJoin" in "".join(plans) and not [p for p in plans if "BroadcastExchange" in p]


def test_near_dedup_broadcasts_no_table(spark, docs, plans):
    last = pipe.keep_one_of_near(spark, docs, "")
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and "SortMergeJoin" in "".join(plans) and not [p for p in plans if "BroadcastExchange" in p]
