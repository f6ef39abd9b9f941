"""Pairing, membership, reconciliation and referential checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import digest_rank


def pair(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Full join on a key. Columns: key, every column of both sides (in structs l and r), status (paired, left_only,
    right_only). Rows with a null key are never paired."""
    a = left.select(left_key.alias("key"), F.struct("*").alias("l"))
    b = right.select(right_key.alias("key"), F.struct("*").alias("r"))
    status = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("paired")
    return a.join(b, "key", "full").withColumn("status", status)


def prefer(df: DataFrame, key: str, kind: str, order: list[str], tie: str) -> DataFrame:
    """Of each key the row whose kind stands first in order; unknown kinds are left out."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(kind))
    best = F.min_by(F.struct(*df.columns), F.struct("_rank", tie))
    return df.withColumn("_rank", rank).where("_rank > 0").groupBy(F.col(key).alias("_key")).agg(best.alias("_best")).select("_best.*")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def allowed_only(df: DataFrame, allowed: DataFrame, keys: list[str], violations: bool = False) -> DataFrame:
    """Rows whose keys all equal those of an allowed row, or the others."""
    return df.join(allowed.select(*keys).distinct(), keys, "left_anti" if violations else "left_semi")


def orphans(child: DataFrame, parent: DataFrame, on: Column) -> DataFrame:
    return child.join(parent, on, "left_anti")


def candidates(plans: DataFrame, pool: DataFrame, on: str, plan_key: str, pool_key: str, k: int, seed: int) -> DataFrame:
    """For each plan the k pool rows of its environment with the least digests.

    The pool is cut into ranks by environment first, and each plan starts at a place of its own in that ring, so a
    plan meets k rows and not the whole pool.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(pool_key).cast("string")), 256)
    ring = digest_rank(pool.withColumn("_d", digest), [on], "_d", pool_key, "_r").withColumn("_at", F.col("_r").cast("int") - 1).drop("_d", "_r")
    size = ring.groupBy(on).agg(F.count("*").alias("_size"))
    start = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(plan_key).cast("string")), 256), 1, 8), 16, 10).cast("long")
    asked = plans.join(size, on).withColumn("rank", F.explode(F.expr(f"sequence(0, cast(least({k}, _size) as int) - 1)")))
    asked = asked.withColumn("_at", ((start + F.col("rank")) % F.col("_size")).cast("int")).drop("_size")
    return asked.join(ring, [on, "_at"]).drop("_at")


def paired_diff(df: DataFrame, pairs: DataFrame, name: str, on: list[str], metrics: list[str]) -> DataFrame:
    """b - a of each metric for the pairs (a, b) of names, matched on the columns `on`."""
    a = df.select(F.col(name).alias("a"), *on, *[F.col(m).alias(f"_a_{m}") for m in metrics])
    b = df.select(F.col(name).alias("b"), *on, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    joined = pairs.join(a, "a").join(b, ["b", *on])
    return joined.select("a", "b", *on, *[(F.col(f"_b_{m}") - F.col(f"_a_{m}")).alias(m) for m in metrics])


def check_catalog(catalog: DataFrame, metrics: DataFrame, key: str, agree: list[str]) -> DataFrame:
    """(key, reason): catalog ids without metrics, and those where a column disagrees."""
    m = metrics.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_m_{c}") for c in agree])
    joined = catalog.join(m, key, "left")
    differs = [F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_m_{c}")), F.lit(c)) for c in agree]
    reasons = F.array_compact(F.array(F.when(F.col("_there").isNull(), F.lit("missing")), *differs))
    return joined.select(key, F.explode(reasons).alias("reason"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, reason): keys that stand on one side only and, column by column, values that are not the same."""
    x = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in cols])
    y = b.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    both = F.col("_a") & F.col("_b")
    reasons = [F.when(F.col("_b").isNull(), "missing_right"), F.when(F.col("_a").isNull(), "missing_left"), *[F.when(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(f"differs:{c}")) for c in cols]]
    return x.join(y, keys, "full").select(*keys, F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def resolve_labels(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, status): the one value of each key, or null with conflict or missing. Only the least and the greatest
    value are kept by key, so a key with many rows stays small."""
    g = df.groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    status = F.when(F.col("_low").isNull(), "missing").when(F.col("_low") == F.col("_high"), "resolved").otherwise("conflict")
    return g.select(key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(value), status.alias("status"))


def is_exact_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of a, duplicates counted, are not in b."""
    return a.exceptAll(b.select(*a.columns)).agg(F.count("*").alias("extra_rows")).withColumn("is_subset", F.col("extra_rows") == 0)


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two key sets and of their intersection and differences, in one full join."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    both = x.join(y, key, "full")
    n = lambda c: F.count_if(c).alias
    out = both.agg(n(F.col("_a").isNotNull())("left_n"), n(F.col("_b").isNotNull())("right_n"), n(F.col("_a") & F.col("_b"))("both_n"), n(F.col("_b").isNull())("left_only_n"), n(F.col("_a").isNull())("right_only_n"))
    return out.withColumn("equal", (F.col("left_only_n") == 0) & (F.col("right_only_n") == 0))


def interleave(a: DataFrame, b: DataFrame, order: list, key: str, by: str) -> DataFrame:
    """(position, source, key) of two ordered lists taken in turn, within each value of `by`."""
    ranked = [df.select(by, key, F.row_number().over(Window.partitionBy(by).orderBy(*order)).alias("position"), F.lit(i).alias("source")) for i, df in enumerate((a, b))]
    return reduce(DataFrame.unionByName, ranked)
