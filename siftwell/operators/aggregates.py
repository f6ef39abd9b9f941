"""Summaries, evaluation metrics and their checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import carried, falling, fields, rising, running, sliced


def long_form(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def distributions(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, value, n): counts of each value of several columns in one pass."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return long_form(text, [], cols, "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, col: str, by: list[str], wanted: dict[str, tuple[float, bool]]) -> DataFrame:
    """Exact quantiles of each group; wanted: name -> (share, interpolate). Nulls do not count.

    Equal values are counted before the shuffle; the distinct ones are cut into ranges at quantiles of a sample, and running counts tell
    which value stands at each rank that is asked for. So no task holds a group, whether its values are all equal or far apart."""
    values = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    upto = running(values, by, rising("_x"), {"_upto": F.col("_n")})
    size = values.groupBy(*by).agg(F.sum("_n").alias("_size"))
    at = {}
    for k, (share, between) in wanted.items():
        place = (F.col("_size") - 1) * share + 1 if between else F.greatest(F.lit(1.0), F.ceil(F.col("_size") * share))
        at[k] = (F.floor(place).cast("long"), F.ceil(place).cast("long"), place - F.floor(place))
    here = lambda rank: (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
    some = upto.join(size, by).where(reduce(lambda p, q: p | q, [here(low) | here(high) for low, high, _ in at.values()]))
    value = lambda rank: F.max(F.when(here(rank), F.col("_x")))
    return some.groupBy(*by).agg(*[(value(low) + (value(high) - value(low)) * F.max(part)).alias(k) for k, (low, high, part) in at.items()])


def describe_exact(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Count, mean, least, quartiles and greatest, with interpolated exact percentiles. Groups without values have nulls."""
    plain = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("minimum"), F.max(col).alias("maximum"))
    quarters = exact_quantiles(df, col, by, {"q1": (0.25, True), "median": (0.5, True), "q3": (0.75, True)})
    return plain.join(quarters, by, "left").select(*by, "n", "mean", "minimum", "q1", "median", "q3", "maximum")


def bin_of(col: Column, edges: list[float]) -> Column:
    """0 below the first edge, k from edge k - 1 on, len(edges) from the last one on."""
    return reduce(lambda out, k: F.when(col >= edges[k], F.lit(k + 1)).otherwise(out), range(len(edges)), F.lit(0))


def bin_counts(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """(bin, n, share) of every bin; empty ones too."""
    counts = df.where(F.col(col).isNotNull()).groupBy(bin_of(F.col(col), edges).alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    filled = bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return filled.crossJoin(F.broadcast(total)).select("bin", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))  # total is one row


def summarise(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, mean, sample_sd, minimum, maximum); the deviation is null for one value."""
    rows = long_form(df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]), by, metrics, "metric", "value")
    return rows.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sample_sd"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))


def verify_summary(raw: DataFrame, published: DataFrame, by: list[str], metrics: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Rows of a published summary that the raw rows do not give within the tolerance, and missing ones, with a reason."""
    keys, values = [*by, "metric"], ["n", "mean", "sample_sd", "minimum", "maximum"]
    a = summarise(raw, by, metrics).select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_{c}") for c in values])
    joined = a.join(published.withColumn("_b", F.lit(True)), keys, "full")
    off = lambda c: ~(F.col(c).eqNullSafe(F.col(f"_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.lit(False)))
    reasons = F.array_compact(F.array(F.when(F.col("_b").isNull(), "not_published"), F.when(F.col("_a").isNull(), "not_computed"), *[F.when(F.col("_a") & F.col("_b") & off(c), F.lit(c)) for c in values]))
    return joined.select(*keys, F.explode(reasons).alias("reason"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(df: DataFrame, by: list[str], truth: Column, guess: Column) -> DataFrame:
    """True and false positives, false negatives, rows, precision, recall, F1 and false positives per row; 0 for 0/0."""
    g = df.groupBy(*by).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count("*").alias("images"))
    return with_prf(g)


def with_prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", images: str = "images") -> DataFrame:
    t, f, m = F.col(tp), F.col(fp), F.col(fn)
    return df.withColumns({"precision": ratio(t, t + f), "recall": ratio(t, t + m), "f1": ratio(2 * t, 2 * t + f + m), "fp_per_image": ratio(f, F.col(images))})


def check_prf(df: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose stored precision, recall or f1 differs from that of their counts."""
    names = ["precision", "recall", "f1"]
    held = df.withColumns({f"_{c}": F.col(c) for c in names})
    fresh = with_prf(held.drop(*names, "fp_per_image"))
    bad = reduce(lambda a, b: a | b, [F.abs(F.col(c) - F.col(f"_{c}")) > tolerance for c in names])
    return fresh.where(bad)


def mean_ap(df: DataFrame, by: list[str], targets: DataFrame, thresholds: list[float], iou: str, confidence: str, tie: str) -> DataFrame:
    """Average precision of each group at each overlap threshold.

    df has a prediction per row with the overlap with its target; targets has `by` and n_targets. Predictions are taken by
    falling confidence, then tie; precision is made non-increasing from the right and summed over the steps of recall. A
    prediction travels once for all thresholds; ranges cut at quantiles of (confidence, tie) are what a task sorts.
    """
    rows = sliced(df.select(*by, iou, confidence, tie), by, falling(confidence, F.col(tie)))
    hits = {f"_t{i}": (F.col(iou) >= t).cast("long") for i, t in enumerate(thresholds)}
    rows = carried(rows, by, "_slice", fields(rows), {"_n": F.lit(1).cast("long"), **hits})
    rows = rows.withColumns({f"_p{i}": F.col(f"_t{i}") / F.col("_n") for i in range(len(thresholds))})
    later = Window.partitionBy(*by).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)  # a row for each range
    tops = rows.groupBy(*by, "_slice").agg(*[F.max(f"_p{i}").alias(f"_m{i}") for i in range(len(thresholds))])
    tops = tops.select(*by, "_slice", *[F.max(f"_m{i}").over(later).alias(f"_l{i}") for i in range(len(thresholds))])
    onward = Window.partitionBy(*by, "_slice").orderBy(*fields(rows)).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.join(tops, [*by, "_slice"]).join(targets, by)
    best = {f"_p{i}": F.greatest(F.max(f"_p{i}").over(onward), F.col(f"_l{i}")) for i in range(len(thresholds))}
    rows = rows.select(*by, iou, "n_targets", *[c.alias(k) for k, c in best.items()])
    ap = [F.sum(ratio((F.col(iou) >= t).cast("long"), F.col("n_targets")) * F.col(f"_p{i}")).alias(f"_a{i}") for i, t in enumerate(thresholds)]
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_a{i}").alias("ap")) for i, t in enumerate(thresholds)])
    return rows.groupBy(*by).agg(*ap).select(*by, F.explode(each).alias("_e")).select(*by, "_e.threshold", "_e.ap")


def map_summary(ap: DataFrame, by: list[str]) -> DataFrame:
    return ap.groupBy(*by).agg(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))


def totals(df: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()])


def resource_rollup(df: DataFrame, job: str, seconds: str, peak: str, retries: Column, order: str) -> DataFrame:
    last = F.max_by(F.col(order), F.struct(order))
    return df.groupBy(job).agg(F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("mean_seconds"), F.max(peak).alias("peak"), F.sum(retries).alias("retries"), last.alias("last_step"))


def latency_quantiles(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Median (interpolated) and nearest-rank 95th percentile."""
    n = df.groupBy(*by).agg(F.count(col).alias("n"))
    return n.join(exact_quantiles(df, col, by, {"median": (0.5, True), "p95": (0.95, False)}), by, "left").select(*by, "n", "median", "p95")


def all_equal(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Whether all rows of a group agree in cols: the least and the greatest digest are the same."""
    d = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.min(d) == F.max(d)).alias("equal"))


def mean_vector(df: DataFrame, population: str, vector: str) -> DataFrame:
    return df.select(population, F.posexplode(vector).alias("dim", "x")).groupBy(population, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def moments(df: DataFrame, population: str, vector: str) -> DataFrame:
    """(population, i, j, n, ci, si, sj, sij): sums over each population's vectors of y_i, y_j and y_i y_j, i <= j, where y is the
    distance x - c from one of its vectors, the least: so large means do not cost digits. Each task adds up its vectors, and only those
    sums, d (d + 1) / 2 rows for a population and task, are shuffled and merged."""

    def run(batches):
        import pandas as pd

        held: dict = {}
        for b in batches:
            for key, part in b.groupby(population):
                c = np.asarray(part["_c"].iloc[0], np.float64)
                y = np.stack(part[vector].to_numpy()).astype(np.float64) - c
                n, s, q, _ = held.get(key, (0, 0.0, 0.0, c))
                held[key] = (n + len(y), s + y.sum(0), q + y.T @ y, c)
        for key, (n, s, q, c) in held.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({population: [key] * len(i), "i": i, "j": j, "n": n, "ci": c[i], "si": s[i], "sj": s[j], "sij": q[i, j]})

    kind = dict(df.dtypes)[population]
    near = df.groupBy(population).agg(F.min(vector).alias("_c"))
    sums = df.select(population, vector).join(near, population).mapInPandas(run, f"{population} {kind}, i int, j int, n long, ci double, si double, sj double, sij double")
    return sums.groupBy(population, "i", "j").agg(F.first("ci").alias("ci"), *[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def covariance(df: DataFrame, population: str, vector: str) -> DataFrame:
    """Sample covariance of each pair of dimensions (i <= j) by population."""
    cov = F.when(F.col("n") > 1, (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1))
    return moments(df, population, vector).select(population, "i", "j", cov.alias("cov"))


def frechet_distances(df: DataFrame, population: str, vector: str) -> DataFrame:
    """(a, b, n_a, n_b, distance) of each two populations a < b. The moments of a population are one row of d (d + 1) / 2 numbers;
    rows are joined and compared in tasks."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "n", "ci", "si", "sij")))
    one = moments(df, population, vector).groupBy(population).agg(F.first("n").alias("n"), cells.alias("m"))
    one = one.select(F.col(population).alias("p"), "n", *[F.col(f"m.{k}").alias(k) for k in ("i", "j", "ci", "si", "sij")])
    sides = [one.select(*[F.col(c).alias(f"{c}_{s}") for c in one.columns]) for s in "ab"]
    pairs = sides[0].join(sides[1], F.col("p_a") < F.col("p_b"))

    def unpacked(r, s: str) -> tuple:
        i, j = (np.asarray(r[f"{c}_{s}"]) for c in "ij")
        n, d = int(r[f"n_{s}"]), int(i.max()) + 1
        q, mean = np.zeros((d, d)), np.zeros(d)
        q[i, j] = q[j, i] = np.asarray(r[f"sij_{s}"])
        mean[i] = np.asarray(r[f"si_{s}"]) / n
        center = np.zeros(d)
        center[i] = np.asarray(r[f"ci_{s}"])
        return n, center + mean, (q - n * np.outer(mean, mean)) / max(1, n - 1)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = b.to_dict("records")
            yield pd.DataFrame({"a": b["p_a"], "b": b["p_b"], "n_a": b["n_a"], "n_b": b["n_b"], "distance": [frechet(unpacked(r, "a"), unpacked(r, "b")) for r in rows]})

    kind = dict(df.dtypes)[population]
    return pairs.mapInPandas(run, f"a {kind}, b {kind}, n_a long, n_b long, distance double")


def frechet(a: tuple, b: tuple) -> float:
    """Distance of two (n, mean, covariance), with the root of the symmetrised product and negative eigenvalues as 0."""
    root = lambda m: (lambda w, v: (v * np.sqrt(np.maximum(w, 0))) @ v.T)(*np.linalg.eigh((m + m.T) / 2))
    s = root(a[2])
    return float(((a[1] - b[1]) ** 2).sum() + np.trace(a[2]) + np.trace(b[2]) - 2 * np.trace(root(s @ b[2] @ s)))


def repeat_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: distinct pairs, rows beyond the first of each pair, objects used, greatest use of an object."""
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n"))
    uses = pairs.groupBy(a).agg(F.sum("n").alias("uses"), F.count("*").alias("pairs"), F.sum(F.col("n") - 1).alias("excess"))
    return uses.agg(F.sum("pairs").alias("pairs"), F.sum("excess").alias("excess_pairs"), F.count("*").alias("objects_used"), F.max("uses").alias("max_uses"))


def duplicate_groups(df: DataFrame, digest: Column, key: str, by: str) -> DataFrame:
    """(digest, n, first, last, conditions) of contents that stand more than once. The group keeps its bounds, not its
    members, so its size does not matter."""
    g = df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"), F.count_distinct(by).alias("conditions"))
    return g.where("n > 1")


def duplicate_members(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """(digest, n, key): a row for each member of a content that stands more than once. Groups are counted and joined back,
    so a large one is never gathered."""
    rows = df.select(digest.alias("digest"), key)
    return rows.join(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "digest").select("digest", "n", key)


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("range"))


def sign_counts(df: DataFrame, by: list[str], diff: Column, epsilon: float) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(diff > epsilon).alias("gains"), F.count_if(diff < -epsilon).alias("losses"), F.count_if(F.abs(diff) <= epsilon).alias("ties"))


def did(df: DataFrame, group: str, value: str, names: tuple[str, str, str, str]) -> DataFrame:
    """(b - a) - (d - c) of group means, and the relative reduction of the first difference, in one pass."""
    mean = {k: F.avg(F.when(F.col(group) == n, F.col(value))).alias(k) for k, n in zip("abcd", names)}
    g = df.where(F.col(group).isin(*names)).agg(*mean.values())
    first, second = F.col("b") - F.col("a"), F.col("d") - F.col("c")
    return g.select(first.alias("first"), second.alias("second"), (first - second).alias("did"), F.when(F.col("a") != 0, -first / F.col("a")).alias("reduction"))


def series_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    gap = F.abs(F.col("_a") - F.col("_b"))
    out = joined.agg(F.count("*").alias("n"), F.max(gap).alias("max_abs"), F.max(F.when(F.col("_a") != 0, gap / F.abs(F.col("_a")))).alias("max_rel"))
    return out.withColumn("within", F.coalesce(F.col("max_abs") <= tolerance, F.lit(True)))


def state_counts(df: DataFrame, state: str, final: list[str]) -> DataFrame:
    return df.groupBy(state).agg(F.count("*").alias("n")).withColumn("terminal", F.col(state).isin(*final))


def reject_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("UNKNOWN")).alias(reason)).agg(F.count("*").alias("n"))


def capacity(supply: DataFrame, target: int, ceiling: int, by: list[str] | None = None) -> DataFrame:
    """For each row of (by, objects): supply under a ceiling of uses against a target, the shortfall and the ceiling needed."""
    n = F.col("objects")
    least = F.when(n > 0, F.ceil(F.lit(float(target)) / n)).cast("long")
    return supply.select(*(by or []), "objects", (n * ceiling).alias("supply"), F.greatest(F.lit(0).cast("long"), F.lit(target) - n * ceiling).alias("shortfall"), least.alias("min_ceiling"), F.when(n * ceiling >= target, "READY").otherwise("BLOCKED").alias("status"))
