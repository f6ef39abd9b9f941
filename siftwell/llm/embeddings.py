"""Embedding near-duplicates with a forest of random-projection trees whose splits overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import components

#: Trees, vectors that a leaf is meant to hold, and vectors of the sample that the splits are fitted on at most.
TREES, LEAF, SAMPLE = 3, 512, 8192
#: Vectors of one label in a leaf that are compared in one task; larger leaves are compared block by block.
BLOCK = 4096
#: Half width of the overlap of a split, as a share of the distance that the projections of two vectors at the least
#: cosine usually have. With this one a level parts 2.7 % of such pairs, so a tree of seven levels keeps 83 % of
#: them and three trees 99.5 %, while a level copies 5 % of the vectors.
SPILL = 0.3


@dataclass
class Tree:
    """Inner nodes in heap order: node k has the children 2k + 1 and 2k + 2."""

    direction: np.ndarray
    cut: np.ndarray
    margin: float

    def leaves(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x): rows near a split go down both sides."""
        todo, out = [(0, np.arange(len(x)))], []
        while todo:
            node, rows = todo.pop()
            if node >= len(self.cut):
                out.append((node - len(self.cut), rows))
                continue
            p = x[rows] @ self.direction[node] - self.cut[node]
            todo += [(2 * node + 1, rows[p < self.margin]), (2 * node + 2, rows[p >= -self.margin])]
        return out


def grow(sample: np.ndarray, depth: int, margin: float, seed: int) -> Tree:
    """Splits at the median of the sample's projections on random directions; all nodes of a level are fitted together."""
    rng = np.random.default_rng(seed)
    n = (1 << depth) - 1
    tree = Tree(rng.normal(size=(n, sample.shape[1])), np.zeros(n), margin)
    tree.direction /= np.linalg.norm(tree.direction, axis=1, keepdims=True) + 1e-300
    parts = {0: np.arange(len(sample))}
    for node in range(n):
        rows = parts.pop(node)
        p = sample[rows] @ tree.direction[node]
        tree.cut[node] = np.median(p) if len(p) else 0.0
        parts[2 * node + 1], parts[2 * node + 2] = rows[p < tree.cut[node]], rows[p >= tree.cut[node]]
    return tree


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _placed(classes: DataFrame, forests: dict[int, list[Tree]], kind: str) -> DataFrame:
    """A row per class and leaf: leaf code, all leaf codes of the class, label, dim, node, n, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                code, row = _codes(unit(_matrix(part.column("e"))), forests[int(d)])
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(code), lists.take(take), *[part.column(c).take(take) for c in ("label", "dim", "node", "n", "e")]], names=["code", "codes", "label", "dim", "node", "n", "e"])

    return classes.mapInArrow(run, f"code long, codes array<long>, label long, dim int, node long, n long, e {kind}")


def _codes(x: np.ndarray, forest: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the leaves of all rows of x in all trees, and the number of their row, ascending."""
    pairs = [(t << 32 | leaf, rows) for t, tree in enumerate(forest) for leaf, rows in tree.leaves(x)]
    code = np.concatenate([np.full(len(r), c, np.int64) for c, r in pairs])
    row = np.concatenate([r for _, r in pairs])
    by = np.lexsort((code, row))
    return code[by], row[by]


def _refined(placed: DataFrame, margins: dict[int, float], kind: str, leaf: int, seed: int, most: int = 60) -> DataFrame:
    """placed with leaves of more than twice `leaf` vectors split on, as often as it takes.

    Each round projects the vectors of the large leaves on a direction of their leaf and cuts at the mean over all of
    them, with the same overlap; leaves that the overlap would copy whole are left for the comparison by blocks.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, dims = batch.column("code").to_numpy(), batch.column("dim").to_numpy()
            p = np.zeros(len(code))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = unit(_matrix(batch.column("e").take(pa.array(rows))))
                leaves, at = np.unique(code[rows], return_inverse=True)
                for k, c in enumerate(leaves.tolist()):
                    v = np.random.default_rng([seed, c]).normal(size=int(d))
                    p[rows[at == k]] = x[at == k] @ (v / np.linalg.norm(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p"])

    now = placed.drop("codes").withColumn("settled", F.lit(False))
    margin = F.element_at(F.create_map(*[F.lit(x) for pair in margins.items() for x in pair]), F.col("dim"))
    for _ in range(most):
        large = saved(now.where("not settled").groupBy("code", "dim").count().where(F.col("count") > 2 * leaf).select("code", "dim"))
        if large.isEmpty():
            break
        rows = now.where("not settled").join(large, ["code", "dim"]).select("code", "label", "dim", "node", "n", "e")
        rows = saved(rows.mapInArrow(project, f"code long, label long, dim int, node long, n long, e {kind}, p double"))
        cuts = rows.groupBy("code", "dim").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd")).withColumn("m", margin)
        both = rows.join(cuts, ["code", "dim"])
        child = lambda side: F.xxhash64("code", F.lit(side)).bitwiseAND(F.lit((1 << 63) - 1))
        left, right = F.when(F.col("p") < F.col("mean") + F.col("m"), child(0)), F.when(F.col("p") >= F.col("mean") - F.col("m"), child(1))
        wide = F.col("sd") > 2 * F.col("m")
        codes = F.when(wide, F.array_compact(F.array(left, right))).otherwise(F.array("code"))
        split = both.select(F.explode(codes).alias("code"), "label", "dim", "node", "n", "e", (~wide).alias("settled"))
        now = saved(now.join(large, ["code", "dim"], "left_anti").select(split.columns).withColumn("settled", F.lit(True)).union(split))
    lists = now.groupBy("node", "dim").agg(F.collect_set("code").alias("codes"))
    return now.drop("settled").join(lists, ["node", "dim"])


def _compare(table: pa.Table, alike: float) -> pa.Table:
    """Links inside a leaf (or between two of its blocks): per vector what is counted here, and the smallest node it meets."""
    table = table.combine_chunks()
    node, n, block = (table.column(c).to_numpy() for c in ("node", "n", "block"))
    code = table.column("code")[0].as_py()
    x = unit(_matrix(table.column("e").combine_chunks()))
    lists = table.column("codes").to_pylist()
    codes = np.full((len(node), max(map(len, lists))), -1, np.int64)
    for i, v in enumerate(lists):
        codes[i, : len(v)] = v
    mixed = len(np.unique(block)) > 1
    order = np.argsort(node, kind="stable")
    node, n, block, x, codes = node[order], n[order].astype(np.float64), block[order], x[order], codes[order]
    kinds, kind = np.unique(codes, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    here = _first_shared(kinds, code)
    count, low, seen = np.zeros(len(node)), np.arange(len(node)), np.zeros(len(node), bool)
    for a in range(0, len(node), 256):
        part = slice(a, min(a + 256, len(node)))
        hit = x[part] @ x.T >= alike
        hit &= np.arange(len(node))[None, :] > np.arange(part.start, part.stop)[:, None]
        if mixed:
            hit &= block[part][:, None] != block[None, :]
        own = (hit & here[kind[part]][:, kind]).astype(np.float64)  # each pair is counted in the first leaf that it shares
        count[part] += own @ n
        count += n[part] @ own
        seen[part] |= hit.any(1)
        seen |= hit.any(0)
        low = _merged(low, *np.nonzero(hit & (low[part][:, None] != low[None, :])), a)
    rows = np.flatnonzero(seen)
    return pa.table({"node": pa.array(node[rows]), "links": pa.array(count[rows].astype(np.int64)), "low": pa.array(node[low[rows]])})


def _first_shared(kinds: np.ndarray, code: int) -> np.ndarray:
    """For each two lists of leaf codes (-1: none) whether `code` is the least that both hold."""
    most = np.iinfo(np.int64).max
    out = np.zeros((len(kinds), len(kinds)), bool)
    for a in range(0, len(kinds), 256):
        mine = kinds[a : a + 256]
        first = np.full((len(mine), len(kinds)), most)
        for s in range(kinds.shape[1]):
            c = mine[:, s]
            shared = np.zeros((len(mine), len(kinds)), bool)
            for k in range(kinds.shape[1]):
                shared |= kinds[:, k][None, :] == c[:, None]
            first = np.where(shared & (c >= 0)[:, None], np.minimum(first, c[:, None]), first)
        out[a : a + 256] = first == code
    return out


def _merged(low: np.ndarray, i: np.ndarray, j: np.ndarray, shift: int) -> np.ndarray:
    """low, the least row that each row is linked to, after the links (i + shift, j)."""
    i = i + shift
    while len(i):
        p, q = low[i], low[j]
        least = np.minimum(p, q)
        np.minimum.at(low, p, least)
        np.minimum.at(low, q, least)
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    return low


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", alike: float = 0.98, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine, in double precision, is `alike` or more. Equal vectors
    of a label (by a 128-bit hash) are one class, compared once. The splits of the trees are fitted on a sample of `sample`
    classes; every class goes down every tree, both ways where it lies close to a split. Where the table needs more levels than the
    sample can fit, large leaves are split on at means over all of their vectors. Within a leaf and label all pairs
    are compared, block by block where the sample tells that they are many, and a pair is counted in the first leaf that it
    shares. Null labels or ids and vectors that are null, empty, zero or hold null or non-finite components link with
    nothing: 0 links, component_id is their own id, kept. Repeated rows are vectors of their own, and so are different vectors
    that share an id. Further columns are ignored; an empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)[vector_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("e"))
    sound = "size(e) > 0 and not exists(e, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(e, x -> x <> 0)"
    good = F.expr(f"id is not null and label is not null and e is not null and coalesce({sound}, false)")
    rows = rows.withColumns({"good": good, "k1": F.xxhash64("e"), "k2": F.xxhash64(F.lit(1), "e")})
    key = ["label", "k1", "k2"]
    classes = rows.where("good").groupBy(*key).agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("e").alias("e"))
    classes = saved(classes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("e")}))
    forests, margins, shares, deep = {}, {}, {}, False
    for dim, n in sorted(classes.groupBy("dim").count().collect()):
        fitted = classes.where(F.col("dim") == dim).orderBy(F.xxhash64(*key), *key).limit(sample).select("label", "e").collect()
        x = unit(np.array([r["e"] for r in fitted]))
        wanted, most = max(0, int(np.ceil(np.log2(n / leaf)))), int(np.log2(max(1, len(x) / 8)))
        deep |= wanted > most
        margins[dim] = SPILL * float(np.sqrt(2 - 2 * alike) / np.sqrt(dim))
        forests[dim] = [grow(x, min(wanted, most), margins[dim], seed + 1000 * t) for t in range(trees)]
        code, row = _codes(x, forests[dim])
        label = np.array([r["label"] for r in fitted])[row]
        for (c, v), k in zip(*(u.tolist() for u in np.unique(np.stack([code, label], 1), axis=0, return_counts=True)), strict=True):
            if (blocks := int(np.ceil(k * n / len(x) / BLOCK))) > 1:
                shares[c, v, dim] = blocks
    placed = _placed(classes, forests, kind)
    if deep:  # more levels than the sample can fit
        placed = saved(_refined(saved(placed), margins, kind, leaf, seed))
        sizes = placed.groupBy("code", "label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
        dealt = placed.join(sizes, ["code", "label", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        many = F.create_map(*[F.lit(x) for (c, v, d), b in shares.items() for x in (f"{c} {v} {d}", b)]) if shares else None
        dealt = placed.withColumn("blocks", F.lit(1) if many is None else F.coalesce(F.element_at(many, F.concat_ws(" ", "code", "label", "dim")), F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")}).drop("other", "blocks")
    found = saved(dealt.groupBy("code", "label", "dim", "b1", "b2").applyInArrow(lambda t: _compare(t, alike), "node long, links long, low long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    of = classes.select(*key, F.col("node").alias("class"), "low", (F.col("n") - 1).alias("copies"))
    of = of.join(links, F.col("class") == F.col("node"), "left").drop("node").join(roots, F.col("class") == F.col("node"), "left")
    of = saved(of.select(*key, "low", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "class").alias("root")))
    first = of.groupBy("root").agg(F.min("low").alias("component"))
    of = of.join(first, "root").select(*key, "links", "component", F.lit(True).alias("good"))
    joined = rows.drop("e").join(of, ["good", *key], "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
