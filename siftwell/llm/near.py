"""Near copies by Jaccard similarity of word shingles: MinHash bands find candidates, the shingles themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import forget, lean, saved, shuffled, small_parts
from .graph import components
from .simhash import fingerprint, links
from .wordhash import BASE, mix, words_in

#: Words of a shingle, and the Jaccard similarity of shingle sets from which texts are near copies.
WORDS, ALIKE = 5, 0.8
#: Bands, and least hashes of each. Texts share a band with probability s ** DEPTH at similarity s: at 0.8 one of 24 in
#: 99.99 % of pairs, at 0.5 in 53 %.
BANDS, DEPTH = 24, 5
#: Texts of a band's key up to which all their pairs are verified at once; beyond, first those with the least text.
PAIRED = 64
#: Bytes of text that a task works on at a time.
CHUNK = 1 << 20


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within their text, and the number of their text.

    Letters A-Z count as lower case. A text of fewer words is one shingle; one without words has none.
    """
    w = words_in([x.lower() for x in texts])
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, np.diff(w.part) != 0))
    length = np.diff(np.append(heads, n))
    left = np.repeat(heads + length, length) - np.arange(n)  # words from here to the end of the text
    h = np.zeros(n, np.uint64)
    for k in range(words):
        at = np.flatnonzero(left > k)
        h[at] = mix(h[at] * np.uint64(BASE) + w.hash[at + k])
    take = (left >= words) | ((np.arange(n) - np.repeat(heads, length) == 0) & (left < words))
    h, part = h[take], w.part[take].astype(np.int64)
    by = np.lexsort((h, part))
    h, part = h[by], part[by]
    new = np.append(True, (np.diff(part) != 0) | (h[1:] != h[:-1]))
    return h[new], part[new]


def band_keys(h: np.ndarray, heads: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """Keys (sets x bands): each mixes the least values of `depth` hash functions over a set."""
    rng = np.random.default_rng(11)
    flip, times = rng.integers(0, 1 << 63, (2, bands * depth), np.int64).view(np.uint64)
    times = times * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(heads), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(heads), b + 1, np.uint64)
        for k in range(b * depth, b * depth + depth):
            key = mix(key * np.uint64(BASE) + np.minimum.reduceat((h ^ flip[k]) * times[k], heads))
        out[:, b] = key
    return out


def marked(docs: DataFrame, words: int = WORDS, bands: int = BANDS, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """docs with node, a hash of the shingle set (0: no words), keys, the set's band keys (none without words), and fp, the SimHash."""
    fields = [*docs.schema.fields, StructField("node", LongType()), StructField("keys", ArrayType(LongType())), StructField("fp", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            at = batch.schema.names.index(text_col)
            sized = batch.set_column(at, "text", pa.compute.fill_null(batch.column(at), "")).rename_columns([f"c{i}" if i != at else "text" for i in range(batch.num_columns)])
            start = 0
            for part in small_parts(sized, CHUNK):
                raw = part.column("text").cast(pa.binary()).to_pylist()
                h, owner = shingles(raw, words)
                node, keys = np.zeros(len(raw), np.uint64), [[] for _ in raw]
                if len(h):
                    heads = np.flatnonzero(np.append(True, np.diff(owner) != 0))
                    node[owner[heads]] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), heads))
                    for i, row in zip(owner[heads], band_keys(h, heads, bands, depth).view(np.int64)):
                        keys[i] = row
                whole = batch.slice(start, len(raw))
                start += len(raw)
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(node.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array([fingerprint(x) for x in raw], np.uint64).view(np.int64))], names=[*whole.schema.names, "node", "keys", "fp"])

    return docs.mapInArrow(lean(run), StructType(fields))


def _verified(base: DataFrame, pairs: DataFrame, words: int, alike: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have Jaccard similarity alike or more. base: (r, node, text)."""
    pairs = saved(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rows = saved(base.select("node", "r").join(shuffled(wanted), "node").groupBy("node").agg(F.min("r").alias("r")).select("r"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in small_parts(batch, CHUNK):
                h, owner = shingles(part.column("text").cast(pa.binary()).to_pylist(), words)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["node", "hashes"])

    some = base.join(rows.hint("shuffle_hash"), "r").select("node", F.coalesce("text", F.lit("")).alias("text"))
    sets = saved(some.mapInArrow(lean(cut), "node long, hashes binary"))
    both = pairs.join(shuffled(sets.toDF("a", "ha")), "a").join(shuffled(sets.toDF("b", "hb")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = 0 if min(len(x), len(y)) < alike * max(len(x), len(y)) - 1e-9 else len(np.intersect1d(x, y, assume_unique=True))
                good.append(n >= alike * (len(x) + len(y) - n) - 1e-9)
            part = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"])

    return both.select("a", "b", "ha", "hb").mapInArrow(lean(judge), "a long, b long")


def fingerprint_edges(base: DataFrame) -> DataFrame:
    """Edges (a, b) that join all nodes of base whose SimHash fingerprints links of 2 differing bits or less connect; found by Golay keys."""
    kinds = saved(base.select("fp", "node").distinct())
    roots = saved(components(links(kinds.select("fp").distinct())))
    rooted = saved(kinds.join(shuffled(roots.toDF("fp", "root")), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "node").distinct())
    low = saved(rooted.groupBy("root").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rooted.join(shuffled(low), "root").where("a < node").select("a", F.col("node").alias("b"))


def near_nodes(base: DataFrame, known: DataFrame | None, words: int = WORDS, alike: float = ALIKE, paired: int = PAIRED) -> DataFrame:
    """(node, root) of the nodes that have a near copy. base: (r, node, keys, text), r a number of its own for each row; known:
    edges (a, b) of nodes that are linked anyway.

    Every pair of a key is verified unless other links already join the two: texts of a key with many are first
    compared with its least one, and then only pairs of different components are.
    """
    keyed = saved(base.select("node", F.explode("keys").alias("key")).distinct())
    sizes = keyed.groupBy("key").count().where("count > 1")
    few = keyed.join(shuffled(sizes.where(F.col("count") <= paired)), "key").select("key", "node")
    many = saved(keyed.join(shuffled(sizes.where(F.col("count") > paired)), "key").select("key", "node"))
    pairs = few.withColumnRenamed("node", "a").join(shuffled(few.withColumnRenamed("node", "b")), "key").where("a < b").select("a", "b")
    stars = many.join(shuffled(many.groupBy("key").agg(F.min("node").alias("a"))), "key").where("a < node").select("a", F.col("node").alias("b"))
    edges = _verified(base, pairs.union(stars), words, alike)
    edges = saved(edges if known is None else edges.union(known))
    roots = saved(components(edges))
    if many.isEmpty():
        return roots
    part = saved(many.join(shuffled(roots), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    kinds = part.select("key", "root").distinct()
    apart = kinds.withColumnRenamed("root", "ra").join(shuffled(kinds.withColumnRenamed("root", "rb")), "key").where("ra < rb")
    a, b = part.toDF("key", "a", "ra"), part.toDF("key", "b", "rb")
    open_ = apart.join(shuffled(a), ["key", "ra"]).join(shuffled(b), ["key", "rb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return components(edges.union(_verified(base, open_, words, alike)))


def near_rows(docs: DataFrame, words: int = WORDS, alike: float = ALIKE, text_col: str = "text", fingerprints: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs with r, a number of the row, and node, and (node, root) of the nodes that have a near copy; both are saved.

    fingerprints: texts whose SimHash fingerprints differ in 2 bits or less are near copies, too.
    """
    base = saved(marked(docs.withColumn("r", F.monotonically_increasing_id()), words, text_col=text_col))
    slim = base.select("r", "node", "keys", F.col(text_col).alias("text"))
    known = saved(fingerprint_edges(base)) if fingerprints else None
    return base.drop("keys", "fp"), saved(near_nodes(slim, known, words, alike))


def near_groups(docs: DataFrame, words: int = WORDS, alike: float = ALIKE, text_col: str = "text") -> DataFrame:
    """docs, row by row, with r, a number of the row, and root: rows with one root are near copies or linked by them.

    Texts of the same shingle set are copies, those without words (null, empty, spaces) too. Ids play no part, so
    rows that share one are told apart. An empty table gives an empty result.
    """
    base, roots = near_rows(docs, words, alike, text_col)
    return base.join(shuffled(roots), "node", "left").withColumn("root", F.coalesce("root", "node")).select(*docs.columns, "r", "root")
