"""Resampling of documents toward a target text distribution, with words found by Aho-Corasick dictionaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import score_rank
from .common import saved, small_parts, texts

#: Bytes of text that share a dictionary.
CHUNK = 2 << 20


def _letters() -> bytes:
    """A-Z become a-z, other ASCII but digits and letters a space, and 0xFF, which is not in UTF-8, the mark between texts."""
    out = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isalnum() else 32
    out[255] = 1
    return bytes(out)


LETTERS = _letters()
MARK = b" \xff "


def _zeros_operators() -> np.ndarray:
    """[k, b, v]: what appending 2^k zero bytes makes of a CRC whose byte b is v; all of it by exclusive or."""
    one = np.array([[zlib.crc32(b"\0", v << (8 * b)) ^ zlib.crc32(b"\0", 0) for v in range(256)] for b in range(4)], np.uint32)
    tables = [one]
    for _ in range(30):
        last = tables[-1]
        tables.append(np.stack([_moved(last[b], last) for b in range(4)]))
    return np.stack(tables)


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


OPERATORS = _zeros_operators()


def composed(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of the concatenations of texts with CRCs a and texts with CRCs b and lengths in bytes."""
    a = a.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        rows = np.flatnonzero(length >> k & 1)
        a[rows] = _moved(a[rows], OPERATORS[k])
    return a ^ b.astype(np.uint32)


def payloads(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of every word of the texts, in their order, and the number of its text.

    Each distinct word, a space on both sides, is a key of an automaton whose payload is its CRC and length; one scan of the texts,
    put one behind the other with a mark between them, emits the payloads.
    """
    joined = MARK.join(raw).translate(LETTERS).decode()
    words = list(set(joined.split(" ")) - {"", "\x01"})
    automaton = ahocorasick.Automaton()
    for w in words:
        b = w.encode()
        automaton.add_word(f" {w} ", zlib.crc32(b) << 31 | len(b))
    automaton.add_word(" \x01 ", 0)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(f" {joined} ")), np.int64)
    marks = found == 0
    return (found[~marks] >> 31).astype(np.uint32), found[~marks] & 0x7FFFFFFF, np.cumsum(marks)[~marks]


def grams(crc: np.ndarray, length: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to `most` words of one text, joined by a space, and the numbers of their texts. A run's payload is
    composed of that of the run without its last word, a space, and that word."""
    crcs, owners, run = [crc], [owner], crc
    space = np.uint32(zlib.crc32(b" "))
    for n in range(2, most + 1):
        whole = owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]
        run = composed(run[: len(whole)], np.full(len(whole), space), np.ones(len(whole), np.int64))
        run = composed(run, crc[n - 1 :], length[n - 1 :])
        crcs.append(run[whole])
        owners.append(owner[: len(whole)][whole])
    return np.concatenate(crcs), np.concatenate(owners)


def features(docs: DataFrame, most: int, buckets: int) -> DataFrame:
    """(id, n_words, buckets) of rows (id, text): the bucket of every feature of a text, as a binary of 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, CHUNK):
                crc, length, owner = payloads(part.column("text").cast(pa.binary()).to_pylist())
                n = np.bincount(owner, minlength=part.num_rows)
                crcs, owners = grams(crc, length, owner, most)
                held = (crcs % np.uint32(buckets))[np.argsort(owners, kind="stable")]
                ends = np.cumsum(np.bincount(owners, minlength=part.num_rows))
                blobs = [held[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "n_words", "buckets"])

    return docs.select("id", "text").mapInArrow(run, "id long, n_words long, buckets binary")


def bucket_counts(held: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall in each bucket; a task hands on a number for each of its buckets, and `buckets` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column("buckets").to_pylist():
                n += np.bincount(np.frombuffer(blob, np.uint32), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in held.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's smoothed shares in the target and in the corpus."""
    k, s, t = float(len(corpus)), corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (null: not drawn).

    Features are all runs of 1 to `most` words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased; a text's weight is the
    floored mean of the gains of its features' buckets (CRC-32 of the feature modulo `buckets`), its score adds Gumbel noise
    from a hash of seed and id, and the highest `percent` of those with `least_words` words are drawn, without
    replacement; equal scores go to the smaller id. Counts cover all features of all texts. Null, empty and wordless texts have
    no features: weight 0. Rows without an id have weight but no score, and are neither drawn nor counted among those drawn
    from. Repeated rows are rows of their own, with one score, and ranks beside each other. Further columns are ignored; an
    empty table gives an empty result, an empty target gains from smoothing alone.
    """
    held = saved(features(texts(docs, id_col, text_col), most, buckets))
    goal = features(texts(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_col), most, buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(held, buckets), bucket_counts(goal, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for blob in batch.column("buckets").to_pylist():
                b = np.frombuffer(blob, np.uint32)
                n.append(len(b))
                weight.append(int(gain.value[b].sum()) // len(b) if len(b) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    rows = held.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    rows = saved(rows.withColumns({"score": (F.col("weight") + noise).cast("long"), "r": F.monotonically_increasing_id()}))
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("id").isNotNull(), F.lit(False))
    drawn = percent * rows.where(fit).count() // 100
    out = ["id", "n_features", "weight", "score"]
    ranked = score_rank(rows.where(fit).select(*out, "r"), [], "score", ["id", "r"], "_rank")
    ranked = ranked.select(*out, F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))
    rest = rows.where(~fit).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.union(rest).withColumnRenamed("id", id_col)
