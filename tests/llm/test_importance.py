"""Importance resampling against brute force, and the registered queries against their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from siftwell.llm import importance as imp
from siftwell.llm import queries
from siftwell.llm.importance import importance_sample

from .conftest import make

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, most=1, k=10_000, percent=10, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % k
    have = [[bucket(g) for g in grams(t, most)] for _, t in rows]
    s, t = Counter(b for f in have for b in f), Counter(bucket(g) for x in target for g in grams(x, most))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + k) / ((s[b] + 1) * (nt + k))))
    out = []
    for (i, text), f in zip(rows, have):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r, (i, text) in zip(out, rows) if i is not None and len(words(text)) >= least), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = n
    return sorted(map(tuple, out), key=str)


TARGET = ["Alpha beta gamma the Quick brown", "été naïve 　 wide", None, ""]


@pytest.mark.parametrize("most", [1, 3])
def test_sample_equals_brute_force(spark, corpus, docs, most):
    target = make(spark, list(enumerate([*TARGET, *[t for _, t in corpus[:4]]])))
    got = sorted((tuple(r) for r in importance_sample(docs, target, most=most).collect()), key=str)
    assert got == plain(corpus, [*TARGET, *[t for _, t in corpus[:4]]], most)
    assert sum(r[4] is not None for r in got) > 5


def test_odd_tables(spark, clashing, empty, corpus):
    rows = [*corpus[:30], *corpus[:3], (None, "null id text here"), (None, None)]
    got = importance_sample(clashing, empty).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    want = plain(rows, [])
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in want), key=str)
    assert ranks == list(range(1, sum(r[4] is not None for r in want) + 1))
    assert importance_sample(empty, clashing).collect() == []


def test_long_texts_and_words(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["ab", "cd", "Ef", "ü", "x1"]) + str(rng.randrange(50_000)) for _ in range(400_000))
    rows = [(1, long), (2, "漢" * 60_000 + " end"), (3, "a" * 300_000), (4, "\x01 \x00 one\x7ftwo")]
    assert sorted((tuple(r) for r in importance_sample(make(spark, rows), make(spark, [(1, "one two")])).collect()), key=str) == plain(rows, ["one two"])


def test_payloads_compose():
    parts = [b"hello", b"", "wörld".encode() * 9, b"x" * 70_000]
    crc = np.array([zlib.crc32(p) for p in parts], np.uint32)
    for a in range(4):
        got = imp.composed(np.full(4, crc[a]), crc, np.array([len(p) for p in parts]))
        assert got.tolist() == [zlib.crc32(parts[a] + p) for p in parts]


DIR = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, str(DIR))
    want = con.execute(queries.SQL[name])
    order = [[c[0] for c in want.description].index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
