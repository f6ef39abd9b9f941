"""Substring dedup, line dedup and packing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import lines, substring
from siftwell.llm.lines import line_dedup
from siftwell.llm.packing import encoder, pack, packed
from siftwell.llm.queries import tokenizer_path
from siftwell.llm.substring import substring_dedup

from .conftest import make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_substring(rows):
    low = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            low[g] = min(low.get(g, i), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for j in range(13)}
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_equals_brute_force(docs, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(docs).collect()}
    assert got == plain_substring(corpus)
    assert sum(v[1] > 0 for v in got.values()) > 20


def test_substring_hot_minimisers(docs, corpus, monkeypatch):
    rows = substring._rows(docs.selectExpr("doc_id as id", "coalesce(text, '') as text"))
    every = np.unique(substring.Runs([(t or "").encode() for _, t in corpus], np.zeros(0, np.uint64)).key)
    ranges = substring.covered(rows, every[::3], 7).collect()
    words = {}
    for r in ranges:
        words.setdefault(r["id"], set()).update(range(r["start"], r["start"] + r["words"]))
    assert {i: len(words.get(i, ())) for i, _ in corpus} == {i: v[1] for i, v in plain_substring(corpus).items()}


def test_substring_odd_tables(clashing, empty):
    assert substring_dedup(empty).count() == 0
    out = substring_dedup(clashing, with_text=True).collect()
    assert len(out) == 35
    assert all(r["n_removed"] == 0 for r in out if r["doc_id"] is None)


def plain_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        keep, all_ = [], (t or "").split("\n")
        for line in all_:
            s = set(WORD.findall(line))
            if s and any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                pass
            else:
                keep.append(line)
            if s:
                seen.append(s)
        out[i] = (len(all_), len(all_) - len(keep), sha("\n".join(keep)))
    return out


def test_lines_equal_brute_force(docs, corpus):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_dedup(docs).collect()}
    assert got == plain_lines(corpus)
    assert sum(v[1] > 0 for v in got.values()) > 20


def test_lines_with_crowds_of_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(20)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(20)] = f"v{rng.randrange(30)}"
        rows.append((i, " ".join(w) + "\n" + " ".join(rng.sample(base, 6)) + f" z{i % 9}"))
    monkeypatch.setattr(lines, "SURE", 1)
    monkeypatch.setattr(lines, "TRIES", 1)  # many lines need the second pass
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_dedup(make(spark, rows)).collect()}
    assert got == plain_lines(rows)


def test_lines_odd_tables(clashing, empty):
    assert line_dedup(empty).count() == 0
    out = line_dedup(clashing, carry=("lang", "id", "h")).collect()
    assert len(out) == 35
    assert all(r["n_removed"] == 0 for r in out if r["doc_id"] is None)


def test_lines_of_repeated_rows_equal_brute_force(spark, corpus):
    rows = corpus[:60] + corpus[:20] + corpus[:5]
    got = [(r["doc_id"], (r["n_lines"], r["n_removed"], r["kept_sha256"])) for r in line_dedup(make(spark, rows)).collect()]
    want = plain_lines(corpus[:60])
    assert sorted(got) == sorted((i, want[i]) for i, _ in rows)
    twice = line_dedup(make(spark, [(7, "one two three\nfour five six")] * 2 + [(9, "four five six\nseven")]), carry=("text",)).collect()
    assert sorted((r["doc_id"], r["kept_text"]) for r in twice) == [(7, "one two three\nfour five six")] * 2 + [(9, "seven")]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


def test_encoder_equals_tokenizer(path, corpus):
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(path), encoder(path)
    odd = ["xx... \u00e9t\u00e9!! \u4f60\u597d, a\u0301b. n\u00b2 \u00aa.", "", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n b", "x  y", "a <|endoftext|> b", "it's 'll 5x", "\x85 a \x1c b", "a\x1f b c"]
    rows = [*[t_ or "" for _, t_ in corpus], *odd]
    for _ in range(2):
        for text, made in zip(rows, encode(rows), strict=True):
            assert np.frombuffer(made, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def best_fit(lengths, room):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(room - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_supersteps_equal_sequential_best_fit(spark, seed):
    rng = random.Random(seed)
    room = rng.choice([16, 50, 128])
    lengths = [rng.randint(1, rng.choice([room, room // 3])) for _ in range(rng.randint(1, 500))]
    counts = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "length int, n long")
    used, ranks = {}, {}
    for r in packed(counts, room, ranges=rng.choice([1, 4, 16])).collect():
        for k in range(r["n"]):
            used.setdefault(r["seq"] + k, []).append((r["offset"], r["size"]))
            ranks.setdefault(r["size"], []).append(r["first"] + k)
    assert all(sorted(v) == list(range(lengths.count(n))) for n, v in ranks.items())
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= room
    assert sorted(x for s in used.values() for _, x in s) == sorted(lengths)
    assert len(used) == best_fit(lengths, room)


def test_pack_pieces(docs, corpus, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = pack(docs, path, room=256).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in corpus}
    seen, rows = {}, {}
    for r in got:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        rows.setdefault(r["doc_id"], []).append(r)
    for i, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(rows[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
        assert len(ids) > 256 or len(rows[i]) == 1
    for spots in seen.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seen) == best_fit([r["length"] for r in got], 256)


def test_pack_odd_tables(clashing, empty, path):
    assert pack(empty, path).count() == 0
    assert pack(clashing, path).where("piece = 0").count() == 35


@pytest.mark.parametrize("few", [-1, 1 << 16])
def test_lines_picked_both_ways(spark, monkeypatch, few):
    """Texts of few lines come by a broadcast table, those of many by a filter."""
    monkeypatch.setattr("siftwell.llm.lines.FEW", few)
    rows = [(1, "a b c d e f\ng h"), (2, "x y\na b c d e f"), (3, "a b c d e\nz"), (4, ""), (5, None)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup(make(spark, rows)).collect()}
    assert got == {1: (2, 0), 2: (2, 1), 3: (2, 1), 4: (1, 0), 5: (1, 0)}


@pytest.mark.parametrize("crowd", [100, 700])
def test_lines_with_crowds_of_doubtful_partners(spark, monkeypatch, crowd):
    """A line whose first partners all fail asks for those that are noted; only where there are more do texts go by filters again."""
    rng = random.Random(4)
    rare, often, other = ([f"{c}{k}" for k in range(n)] for c, n in (("r", 9), ("f", 31), ("g", 29)))
    swapped = lambda n: " ".join(rare + rng.sample(often, 31 - n) + rng.sample(other, n))
    rows = [(0, swapped(4)), *((k + 1, swapped(5)) for k in range(crowd)), (2000, swapped(0)), (3000, "\n".join(f"{x} " * 5000 for x in often + other))]
    filters, made = [], lines.bit_filter
    monkeypatch.setattr(lines, "bit_filter", lambda slots: filters.append(1) or made(slots))
    got = {(r["id"], r["line"]) for r in lines.similar_lines(spark.createDataFrame([(i, i, t) for i, t in rows], "id long, h long, text string")).collect()}
    sets = [(i, k, {*x.split()}) for i, t in rows for k, x in enumerate(t.split("\n"))]
    want = {(i, k) for n, (i, k, x) in enumerate(sets) if any(len(x & y) >= 0.8 * len(x | y) - 1e-9 for _, _, y in sets[:n])}
    assert got == want and (2000, 0) in want
    assert bool(filters) == (crowd > lines.DEEP)


def test_pairs_of_a_crowd_grow_with_it_not_with_its_square():
    """A line notes the same number of doubtful partners whatever the crowd; the others are kept as entries, once each."""

    def made(crowd):
        rng = random.Random(4)
        rare, often, other = ([f"{c}{k}" for k in range(n)] for c, n in (("r", 9), ("f", 31), ("g", 29)))
        texts = [" ".join(rare + rng.sample(often, 29) + rng.sample(other, 2)) for _ in range(crowd)]
        part = pa.RecordBatch.from_pydict({"id": list(range(crowd)), "h": list(range(crowd)), "text": texts})
        classes = np.full(lines.COUNTERS, 9, np.uint8)
        classes[lines._counter(lines.line_words([" ".join(rare).encode()])[0])] = 0  # these come first
        return pa.concat_tables(lines._pairs(pa.Table.from_batches([x]), 0.8, False) for x in lines._entries(part, classes, 1, 0.8, None))

    small, large = (made(n) for n in (60, 240))
    assert 0 < large.num_rows < 6 * small.num_rows
    kept = [x for x in large.column("kept").to_pylist() if x]
    assert len(kept) == 1 and len(lines._Bucket.opened(kept[0]).id) <= 9 * 240


def test_entries_that_may_be_alike_meet_once_by_size():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 90, 500)
    pos = (rng.random(500) * lines._prefix(size, 0.8)).astype(np.int64)
    of, band, key = lines._met(np.zeros(500, np.uint32), size, pos, 0.8)
    rest, home = size - pos, band == lines._band(size[of])
    i, j = np.nonzero((key[:, None] == key) & (of[:, None] > of) & (home[:, None] | home))
    met = sorted(zip(of[i].tolist(), of[j].tolist()))
    assert len(set(met)) == len(met) < 500 * 499 // 2 * 0.4
    s, t = size[:, None], size
    may = (np.minimum(s, t) >= 0.8 * np.maximum(s, t) - 1e-9) & (np.minimum(rest[:, None], rest) >= np.ceil(0.8 / 1.8 * (s + t) - 1e-9))
    assert {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(may))) if a > b} <= set(met)
