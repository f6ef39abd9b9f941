"""Exact top-k search by inner product: a KD-tree for each shard, searched best first under a kth score that shards hand on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Vectors of a leaf; vectors that the cells are fitted on (about); cells at most; queries of a task at most (about).
LEAF, SAMPLE, CELLS, QUERIES = 128, 8192, 1024, 16384
#: The id of rows without one: it comes last among ties and is null again in the result. The score of a query without k results.
NONE, NO_SCORE = int(np.iinfo(np.int64).max), int(np.iinfo(np.int64).min)


@dataclass
class Tree:
    """A KD-tree in heap order: node k has the children 2k + 1 and 2k + 2. Each node has the tight box of its vectors, their least id,
    and the range of `order` that they take."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray

    @property
    def first_leaf(self) -> int:
        return len(self.start) // 2


def grow(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Splits at the median of the component that spreads most, until leaves have `leaf` vectors or fewer."""
    depth = max(0, int(np.ceil(np.log2(len(x) / leaf)))) if len(x) else 0
    n = (2 << depth) - 1
    start, end, order = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(len(x))
    low, high, least = np.zeros((n, x.shape[1]), x.dtype), np.zeros((n, x.shape[1]), x.dtype), np.zeros(n, np.int64)
    end[0] = len(x)
    for node in range(n):
        rows = order[start[node] : end[node]]
        low[node], high[node], least[node] = x[rows].min(0), x[rows].max(0), ids[rows].min()
        if 2 * node + 2 < n:
            half = len(rows) // 2
            part = np.argpartition(x[rows, (high[node] - low[node]).argmax()], half)
            order[start[node] : end[node]] = rows[part]
            start[2 * node + 1], end[2 * node + 1] = start[node], start[node] + half
            start[2 * node + 2], end[2 * node + 2] = start[node] + half, end[node]
    return Tree(order, start, end, low, high, least)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product that a query can have with a point of a box: query x box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, score: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query, and least values where there are fewer. rows and own tell which vector is a query's
    own; (score, tie) is a kth result that the query has elsewhere, and what is worse is not looked for.

    All queries go in step: each takes the open node of its highest bound, opens its children or scores its leaf, and is done when
    that bound is under its kth score.
    """
    none = -np.inf if q.dtype == np.float64 else NO_SCORE
    box = bounds(q, tree.low, tree.high)
    waiting = np.full(box.shape, none, q.dtype)
    waiting[:, 0] = box[:, 0]
    best, id_ = np.full((len(q), k), none, q.dtype), np.full((len(q), k), NONE)
    kth, last = score.copy(), tie.copy()
    active = np.arange(len(q))
    while len(active):
        node = waiting[active].argmax(1)
        top = waiting[active, node]
        on = (top > none) & (top >= kth[active])
        active, node, top = active[on], node[on], top[on]
        waiting[active, node] = none
        of_use = (top > kth[active]) | (tree.least[node] <= last[active])
        inner = of_use & (node < tree.first_leaf)
        for side in (1, 2):
            child = 2 * node[inner] + side
            waiting[active[inner], child] = box[active[inner], child]
        at_leaf = np.flatnonzero(of_use & (node >= tree.first_leaf))
        at_leaf = at_leaf[np.argsort(node[at_leaf], kind="stable")]
        for group in np.split(at_leaf, np.flatnonzero(np.diff(node[at_leaf])) + 1) if len(at_leaf) else []:
            a, leaf = active[group], tree.order[tree.start[node[group[0]]] : tree.end[node[group[0]]]]
            s = q[a] @ x[leaf].T
            s[own[a][:, None] == rows[leaf][None, :]] = none
            good = (s > kth[a][:, None]) | ((s == kth[a][:, None]) & (ids[leaf][None, :] <= last[a][:, None]))
            hit = good.any(1)
            a, s = a[hit], s[hit]
            both, names = np.concatenate([best[a], s], 1), np.concatenate([id_[a], np.broadcast_to(ids[leaf], s.shape)], 1)
            order = np.lexsort((names, -both))[:, :k] if none == -np.inf else np.lexsort((names, ~both))[:, :k]
            best[a], id_[a] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            better = (best[a, -1] > kth[a]) | ((best[a, -1] == kth[a]) & (id_[a, -1] < last[a]))
            kth[a[better]], last[a[better]] = best[a[better], -1], id_[a[better], -1]
    return best, id_


def scaled(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * component) of vectors of one length, in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and q in doubles where all inner products are exact in them, else in 64-bit integers."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if most < 2**53:
        return x, q
    if most >= 2**63:
        raise OverflowError("inner products that do not fit in 64 bits")
    return x.astype(np.int64), q.astype(np.int64)


def _cell(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of each row: down a tree of (component, cut) nodes."""
    axis, cut = fitted
    node = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(len(axis) + 1))):
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] >= cut[node])
    return node - len(axis)


def _fit(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    n = (1 << depth) - 1
    axis, cut, held = np.zeros(n, np.int64), np.zeros(n), {0: np.arange(len(x))}
    for node in range(n):
        rows = held.pop(node)
        v = x[rows]
        axis[node] = (v.max(0) - v.min(0)).argmax() if len(rows) else 0
        p = v[:, axis[node]]
        cut[node] = np.median(p) if len(rows) else 0
        held[2 * node + 1], held[2 * node + 2] = rows[p < cut[node]], rows[p >= cut[node]]
    return axis, cut


def _boxes(placed: DataFrame, scale: int) -> list:
    """(dim, cell, n, low, high) of all cells: a task hands on a box for each of its cells, and they are merged component by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            dim, cell = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                x = scaled(batch.column("e").take(pa.array(rows)), scale)
                for c in np.unique(cell[rows]).tolist():
                    part = x[cell[rows] == c]
                    now = held.setdefault((d, c), [0, part[0], part[0]])
                    held[d, c] = [now[0] + len(part), np.minimum(now[1], part.min(0)), np.maximum(now[2], part.max(0))]
        out = [(d, c, n, low.tolist(), high.tolist()) for (d, c), (n, low, high) in held.items()]
        names, kinds = ["dim", "cell", "n", "low", "high"], [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    parts = placed.select("dim", "cell", "e").mapInArrow(run, "dim int, cell int, n long, low array<double>, high array<double>")
    sizes = parts.groupBy("dim", "cell").agg(F.sum("n").alias("n"))
    ends = parts.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("dim", "cell", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    ends = ends.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("b"))
    return sizes.join(ends, ["dim", "cell"]).select("dim", "cell", "n", F.transform("b", lambda b: b["low"]).alias("low"), F.transform("b", lambda b: b["high"]).alias("high")).collect()


def _routed(queries: DataFrame, cells: dict[int, dict], kind: str, scale: int, seeds: bool) -> DataFrame:
    """(dim, cell, block, r, q, score, tie): the shards that each query goes to. seeds: one, of the cell with the highest bound; else all
    others of cells whose bound is not under the query's kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                c = cells[d]
                box = bounds(scaled(part.column("e"), scale), c["low"], c["high"])
                r, score = part.column("r").to_numpy(), part.column("score").to_numpy().astype(np.float64)
                home = box.argmax(1)
                at = r % c["blocks"][home]
                if seeds:
                    row, cell, block = np.arange(len(r)), home, at
                else:
                    row, cell = np.nonzero(box >= (score - 1e-9 * np.abs(score))[:, None])  # doubles may be off where scores are beyond 2^53
                    n = c["blocks"][cell]
                    row, cell, block = np.repeat(row, n), np.repeat(cell, n), np.concatenate([np.arange(v) for v in n.tolist()] or [np.zeros(0, np.int64)])
                    other = (cell != home[row]) | (block != at[row])
                    row, cell, block = row[other], cell[other], block[other]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), d), pa.int32()), pa.array(c["cell"][cell], pa.int32()), pa.array(block, pa.int32()), *[part.column(f).take(take) for f in ("r", "e", "score", "tie")]],
                    names=["dim", "cell", "block", "r", "q", "score", "tie"],
                )

    return queries.select("dim", "r", "e", "score", "tie").mapInArrow(run, f"dim int, cell int, block int, r long, q {kind}, score long, tie long")


def _found(placed: DataFrame, routed: DataFrame, blocks: DataFrame, k: int, scale: int) -> DataFrame:
    """(r, score, id): the k best of each query in each shard that it goes to. A shard meets its queries chunk by chunk."""

    def meet(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["r", "score", "id"])
        vectors, asked = vectors.combine_chunks(), asked.combine_chunks()
        x, q = exact(scaled(vectors.column("e").combine_chunks(), scale), scaled(asked.column("q").combine_chunks(), scale))
        ids, r = vectors.column("id").to_numpy(), asked.column("r").to_numpy()
        none = -np.inf if q.dtype == np.float64 else NO_SCORE
        score = asked.column("score").to_numpy()
        score = np.where(score == NO_SCORE, none, score.astype(q.dtype))
        best, id_ = search(grow(x, ids), x, ids, vectors.column("r").to_numpy(), q, r, k, score, asked.column("tie").to_numpy().copy())
        row, col = np.nonzero(best > none)
        return pa.table([pa.array(r[row]), pa.array(best[row, col].astype(np.int64)), pa.array(id_[row, col])], names=["r", "score", "id"])

    most = routed.groupBy("dim", "cell", "block").count().groupBy("dim", "cell").agg(F.ceil(F.max("count") / QUERIES).cast("int").alias("chunks"))
    most = F.broadcast(saved(most))  # a row for each cell
    left = placed.join(F.broadcast(blocks), ["dim", "cell"]).join(most, ["dim", "cell"])
    left = left.withColumn("block", F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = routed.join(most, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("r"), F.col("chunks")).cast("int"))
    key = ["dim", "cell", "block", "chunk"]
    return left.select(*key, "r", "id", "e").groupBy(*key).cogroup(right.select(*key, "r", "q", "score", "tie").groupBy(*key)).applyInArrow(meet, "r long, score long, id long")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, is_query: Column | None = None) -> DataFrame:
    """query_id, rank (from 1), id and score of each query's k highest inner products of floor(scale * component), exact, ties to
    the smaller id.

    Queries are the rows with is_query (by default those with an id divisible by 100), candidates all rows but the query's own:
    repeated rows are candidates of each other, and queries each, whose results stand beside each other. Vectors are put in cells
    by a KD-tree of a sample, and cells are dealt into shards of bounded size, so equal vectors are dealt out too. A query first
    searches one shard, and its kth result goes along to all other shards whose cell's box can reach it; a shard builds its
    KD-tree and is searched best first. Vectors that are null, empty or hold null or non-finite components take no part, and
    only vectors of one length meet; a row without an id is a candidate, behind others of its score, with a null id.
    Fewer than k candidates are all returned. Further columns are ignored; an empty table gives an empty result.
    Inner products that do not fit in 64 bits are an error.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[vector_col]
    sound = "size(e) > 0 and not exists(e, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    asks = F.col("_id") % 100 == 0 if is_query is None else is_query
    rows = vectors.select("*", F.col(id_col).cast("long").alias("_id")).select(F.coalesce("_id", F.lit(NONE)).alias("id"), F.col(vector_col).alias("e"), F.coalesce(asks & F.col("_id").isNotNull(), F.lit(False)).alias("asks"))
    rows = rows.where(F.expr(f"e is not null and coalesce({sound}, false)")).withColumn("dim", F.size("e"))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    fitted = {}
    for dim, n in sizes.items():
        shard = min(65536, max(1024, 16 * n**0.5))
        some = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id", "e"), F.lit(-(-n // SAMPLE))) == 0)).select("e").distinct()
        x = np.floor(scale * np.array([r["e"] for r in some.collect()], np.float64).reshape(-1, dim))
        depth = min(np.log2(CELLS), np.ceil(np.log2(max(1, n / shard))), np.log2(max(1, len(x) / 8)) // 1)
        fitted[dim] = (_fit(x, int(depth)), int(shard))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                cell[at] = _cell(scaled(batch.column("e").take(pa.array(at)), scale), fitted[d][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = rows.mapInArrow(place, f"id long, e {kind}, asks boolean, dim int, cell int")
    placed = saved(placed.withColumn("r", F.monotonically_increasing_id()))
    cells: dict[int, dict] = {}
    told = _boxes(placed, scale)
    for dim, (_, shard) in fitted.items():
        own = [r for r in told if r["dim"] == dim]
        part = {c: np.array([r[c] for r in own]) for c in ("cell", "n", "low", "high")}
        cells[dim] = part | {"blocks": -(-part["n"] // shard)}
    blocks = spark.createDataFrame([(d, int(c), int(b)) for d, p in cells.items() for c, b in zip(p["cell"], p["blocks"], strict=True)], "dim int, cell int, blocks int")
    queries = placed.where("asks").select("dim", "r", "id", "e")
    open_ = queries.withColumns({"score": F.lit(NO_SCORE), "tie": F.lit(NONE)})
    seeds = saved(_found(placed, _routed(open_, cells, kind, scale, True), blocks, k, scale))
    worst = F.max(F.struct((-F.col("score")).alias("s"), "id"))
    kth = seeds.groupBy("r").agg(F.count("*").alias("n"), worst.alias("w")).where(F.col("n") == k).select("r", (-F.col("w.s")).alias("score"), F.col("w.id").alias("tie"))
    led = queries.drop("id").join(kth, "r", "left").withColumns({"score": F.coalesce("score", F.lit(NO_SCORE)), "tie": F.coalesce("tie", F.lit(NONE))})
    found = seeds.union(_found(placed, _routed(led, cells, kind, scale, False), blocks, k, scale))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    out = ranked.join(queries.select("r", F.col("id").alias("query_id")), "r")
    return out.select("query_id", "rank", F.when(F.col("id") != NONE, F.col("id")).alias(id_col), "score")
