"""SimHash near-duplicates, found through Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_rows, saved, shuffled, texts
from .graph import components

#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xC75
#: The three segments of a fingerprint: first bit and number of bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no words."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """syndromes: of each of the 23 unit words; errors: for each syndrome the error words (-1: none) that lead to the
    codewords within distance 4. The code is perfect, so there are one or six of them."""
    unit = np.zeros(23, np.int64)
    for i in range(23):
        x = 1 << i
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        unit[i] = x
    errors, weight = np.full((2048, 6), -1, np.int64), np.full(2048, 9)
    for k in range(5):
        for at in combinations(range(23), k):
            s = int(np.bitwise_xor.reduce(unit[list(at)])) if at else 0
            weight[s] = min(weight[s], k)
            if k <= 3 or weight[s] == 3:
                errors[s, np.argmax(errors[s] < 0)] = sum(1 << i for i in at)
    return unit, errors


def golay_keys(fps: np.ndarray, tables=None) -> np.ndarray:
    """Keys (n x 18, -1: none) of fingerprints: any two with at most two differing bits share a key.

    By the pigeonhole principle two errors leave one of three segments exact; the next one then has at most two
    errors, and words of the Golay space at distance 2 or less always have a codeword within distance 4 of both. A
    key is the number of the exact segment, its bits, and the 12-bit index of such a codeword for the next segment.
    """
    unit, errors = tables or golay_tables()
    fps = fps.astype(np.uint64)
    cut = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    out = np.full((len(fps), 18), -1, np.int64)
    for i in range(3):
        word = cut[(i + 1) % 3]
        s = np.zeros(len(fps), np.int64)
        for b in range(23):
            s ^= np.where(word >> b & 1, unit[b], 0)
        e = errors[s]
        key = (np.int64(i) << 34) | (cut[i][:, None] << 12) | ((word[:, None] ^ e) >> 11)
        out[:, 6 * i : 6 * i + 6] = np.where(e < 0, -1, key)
    return out


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            keys = golay_keys(fp.view(np.uint64), tables)
            row, _ = np.nonzero(keys >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keys >= 0]), pa.array(fp[row])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (column fp) whose distance is 2 or less.

    Fingerprints that share a Golay key with another one are candidates; no other one can have a link. They are verified
    exactly without comparing pairs: two fingerprints share a point of their radius-1 balls if, and only if, they differ in
    2 bits or less, so the fingerprints around a point, 65 at most, hang on the smallest. Edges grow in proportion to the
    candidates, however many share a key.
    """
    keyed = saved(_keyed(distinct))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    crowd = keyed.join(shuffled(shared), "key").select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    ball = crowd.select("fp", F.explode(flips).alias("point"))
    low = ball.groupBy("point").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return ball.join(shuffled(low), "point").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Fingerprints link at 2 or fewer differing bits. Texts without words (null, empty, spaces) have fingerprint zero
    and link like any other. Exact copies meet in an aggregation by fingerprint before anything is compared. Rows
    with a null id get their fingerprint and their component's smallest id (null if it has none). Repeated ids are
    kept row by row; further columns are ignored; an empty table gives an empty result.
    """

    def make():
        return lambda ids, rows: {"id": ids, "fp": np.array([fingerprint(x, words) for x in rows], np.uint64).view(np.int64)}

    marks = saved(map_rows(texts(docs, id_col, text_col), make, "id long, fp long"))
    distinct = saved(marks.groupBy("fp").agg(F.min("id").alias("low")))
    joined = saved(components(links(distinct)))
    root = distinct.join(shuffled(joined), F.col("fp") == F.col("node"))
    root = root.join(shuffled(root.groupBy("root").agg(F.min("low").alias("component_id"))), "root").select("fp", "component_id")
    of = saved(distinct.join(shuffled(root), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return marks.join(shuffled(of), "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
