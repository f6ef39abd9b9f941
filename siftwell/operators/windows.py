"""Normalising, ranking, sampling and series operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_rank
from .durable import durable
from .ranges import carried, falling, fields, find_cuts, following, placed, recent, rising, seen_lately, sliced


def bucket_rank(df: DataFrame, by: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """Adds the rank 1, 2, ... of each row within `by` in an order that starts with a bucket.

    A rank is the number of rows in earlier buckets plus the one within the bucket: a task holds a bucket of a stratum, and
    one counter for each bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    return carried(rows, by, "_bucket", order, {name: F.lit(1).cast("long")}).drop("_bucket")


def digest_rank(df: DataFrame, by: list[str], digest: str, tie: str, name: str) -> DataFrame:
    """Rank within `by` in the order of a hex digest; its first three digits deal the rows out evenly."""
    return bucket_rank(df, by, F.substring(F.col(digest), 1, 3), [F.col(digest), F.col(tie)], name)


def score_rank(df: DataFrame, by: list[str], score: str, ties: list, name: str) -> DataFrame:
    """Rank within `by` by falling score (nulls last), then ties, the last of which should tell rows apart: ranges cut at quantiles of
    (score, ties) deal the rows out, so neither outliers nor equal scores bring a group together."""
    rows = sliced(df, by, falling(score, *ties))
    return bucket_rank(rows, by, F.col("_slice"), fields(rows), name).drop("_o", "_slice", "_cut")


def first_of(score: Column, tie: str) -> Column:
    """A value that is least for the greatest score (nulls last) and the least tie, which may be of any ordered type."""
    return F.struct(score.isNull().alias("n"), (-score).alias("s"), F.col(tie).alias("t"))


def minmax(df: DataFrame, cols: dict[str, bool], by: list[str] | None = None) -> DataFrame:
    """Adds col_norm in 0..1 for each column (True: inverted); 0.5 where all values are equal.

    The ends come from one aggregation, joined back: a row for each value of `by`, or one row.
    """
    ends = [f for c in cols for f in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))]
    wide = df.join(df.groupBy(*by).agg(*ends), by) if by else df.crossJoin(F.broadcast(df.agg(*ends)))  # one row
    for c, invert in cols.items():
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        part = (F.col(c) - F.col(f"_lo_{c}")) / span
        wide = wide.withColumn(f"{c}_norm", F.when(span == 0, F.lit(0.5)).otherwise(F.lit(1.0) - part if invert else part))
    return wide.drop(*[f"_{e}_{c}" for c in cols for e in ("lo", "hi")])


def hardness(df: DataFrame, weights: dict[str, tuple[float, bool]], name: str = "score") -> DataFrame:
    """Weighted sum of normalised features; weights: column -> (weight, small is hard)."""
    wide = minmax(df, {c: invert for c, (_, invert) in weights.items()})
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"{c}_norm") for c, (w, _) in weights.items()])
    return wide.withColumn(name, total).drop(*[f"{c}_norm" for c in weights])


def stratified_topk(df: DataFrame, quotas: DataFrame, by: str, order: list, rank: str = "rank", most: int | None = None) -> DataFrame:
    """Rows of rank <= the stratum's quota. quotas: (by, quota), a row for each stratum.

    With `most`, a number that no quota exceeds, each task hands on that many rows of a stratum at most.
    """
    w = Window.partitionBy(by).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    if most is not None:
        ranked = ranked.where(F.col(rank) <= most)
    return ranked.join(quotas, by).where(F.col(rank) <= F.col("quota")).drop("quota")


def shortage(df: DataFrame, quotas: DataFrame, by: str) -> DataFrame:
    """(by, quota, available, short) of each stratum."""
    n = df.groupBy(by).agg(F.count("*").alias("_n"))
    out = quotas.join(n, by, "left").withColumn("available", F.coalesce("_n", F.lit(0)))
    return out.select(by, "quota", "available", F.greatest(F.lit(0), F.col("quota") - F.col("available")).alias("short"))


def keep_best(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Adds removed: true for all but the best row of each group (score, then least tie). Null groups are never removed.

    The best is found by an aggregation, written, and joined back: so its size is known to the join, which broadcasts it or splits
    what is skewed, and a large group is never gathered.
    """
    best = durable(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(tie, first_of(F.col(score), tie)).alias("_best")))
    joined = df.join(best, group, "left")
    return joined.withColumn("removed", F.col(group).isNotNull() & (F.col(tie) != F.col("_best"))).drop("_best")


def hash_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The first n rows by digest of seed and key, then key."""
    return df.withColumn("rank_digest", hash_rank(seed, F.col(key))).orderBy("rank_digest", key).limit(n)


def bottom_k(df: DataFrame, by: list[str], digest: str, ties: list[str], k: int, name: str = "rank", fan: int = 64) -> DataFrame:
    """The k rows of each group with the least digests, ranked. Each task holds on to k rows of a group in each of `fan` classes of
    digests and hands on no more; their k least are merged class by class, then the classes. So what is shuffled is bounded by
    k, not by the size of a group, and the last merge of a group sees fan x k rows at most."""
    order = [F.col(digest), *[F.col(t) for t in ties]]
    rows = df.withColumn("_class", F.pmod(F.xxhash64(digest), F.lit(fan)))
    part = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_class").orderBy(*order))).where(F.col("_in") <= k).drop("_in", "_class")
    return part.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def hash_sample_by(df: DataFrame, by: str, n: int, seed: int, key: str) -> DataFrame:
    """The first n rows of each stratum by digest of seed and key, then key."""
    return bottom_k(df.withColumn("rank_digest", hash_rank(seed, F.col(key))), [by], "rank_digest", [key], n)


def round_robin(df: DataFrame, stratum: str, n: int, key: str) -> DataFrame:
    """Takes one row of each stratum in turn until there are n; a stratum can give n at most."""
    w = Window.partitionBy(stratum).orderBy(key)
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return ranked.orderBy("turn", stratum).limit(n)


def extremes(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    o = F.struct(*order)
    return df.groupBy(by).agg(F.min_by(value, o).alias("first"), F.max_by(value, o).alias("last"))


def compare_selections(df: DataFrame, n: int, seed: int, key: str, score: str, valid: Column | None = None, expected: Column | None = None) -> DataFrame:
    """(method, key, rank) of n rows by digest (random) and of n by score, then digest (task).

    The pool is checked first, in one aggregation: it must have n rows at least, no repeated or null key, only valid rows,
    and (if told) scores that equal what is expected within 1e-9; otherwise a ValueError tells what is wrong.
    """
    sound = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    exact = F.lit(True) if expected is None else F.coalesce(F.abs(expected - F.col(score)) <= 1e-9, F.lit(False))
    seen = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(~sound).alias("invalid"), F.count_if(F.col(score).isNull()).alias("unscored"), F.count_if(~exact).alias("tampered")).first()
    if seen["rows"] < n or seen["keys"] < seen["rows"]:
        raise ValueError("too few rows, or keys that are null or repeated")
    if seen["invalid"] or seen["unscored"] or seen["tampered"]:
        raise ValueError("rows that are not valid, have no score, or one that differs from the formula")
    pool = df.withColumn("_d", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256))
    order = {"random": [F.col("_d"), F.col(key)], "task": [F.desc(score), F.col("_d"), F.col(key)]}
    parts = [pool.orderBy(*o).limit(n).select(F.lit(m).alias("method"), key, F.row_number().over(Window.orderBy(*o)).cast("long").alias("rank")) for m, o in order.items()]  # n rows
    return parts[0].unionByName(parts[1])


def selection_statistics(chosen: DataFrame, df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(method, field, value, n): how the rows of each method spread over fields of df, and how many keys both methods
    share (method `both`, field `overlap`)."""
    rows = chosen.join(df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]), key)
    long = rows.select("method", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("p"))
    stats = long.groupBy("method", "p.field", "p.value").agg(F.count("*").alias("n"))
    shared = chosen.groupBy(key).agg(F.count_distinct("method").alias("_m")).agg(F.count_if(F.col("_m") == 2).alias("n"))
    return stats.unionByName(shared.select(F.lit("both").alias("method"), F.lit("overlap").alias("field"), F.lit(None).cast("string").alias("value"), "n"))


def balance(df: DataFrame, population: str, seed: int, key: str) -> DataFrame:
    """Of each population as many rows as the smallest has, by digest."""
    ranked = digest_rank(df.withColumn("_d", hash_rank(seed, F.col(key))), [population], "_d", key, "rank").drop("_d")
    least = df.groupBy(population).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    return ranked.crossJoin(F.broadcast(least)).where(F.col("rank") <= F.col("_least")).drop("_least")  # one row


def sequence_names(df: DataFrame, by: str, key: str, prefix: Column, slices: int = 1000) -> DataFrame:
    """Adds seq and new_name: numbers 1, 2, ... in the order of an integer key within `by`."""
    ranked = bucket_rank(df, [by], F.floor(F.col(key) / slices), [F.col(key)], "seq")
    return ranked.withColumn("new_name", F.concat(prefix, F.lit("_"), F.lpad(F.col("seq").cast("string"), 6, "0")))


def check_series(df: DataFrame, key: str, pos: str, value: str | None = None) -> DataFrame:
    """Per key: n, first, last and whether the positions are 1..n (or first..first + n - 1) without repeats and all
    values finite."""
    sound = F.lit(True) if value is None else F.bool_and(~F.isnan(value) & F.col(value).isNotNull())
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.min(pos).alias("first"), F.max(pos).alias("last"), F.count_distinct(pos).alias("_d"), sound.alias("_ok"))
    return g.select(key, "n", "first", "last", ((F.col("_d") == F.col("n")) & (F.col("last") - F.col("first") + 1 == F.col("n")) & F.col("_ok")).alias("continuous"))


def best_of(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """The row of the greatest score of each series, the earliest on ties."""
    best = F.min_by(F.struct(pos, score), first_of(F.col(score), pos))
    return df.groupBy(key).agg(best.alias("_b")).select(key, F.col(f"_b.{pos}").alias("best_pos"), F.col(f"_b.{score}").alias("best_score"))


def curve(df: DataFrame, by: list[str], step: Column, value: str) -> DataFrame:
    return df.groupBy(*by, step.alias("step")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_sd"))


def eta(df: DataFrame, key: str, order: list[str], seconds: str, total: int, k: int = 5) -> DataFrame:
    """Adds done and remaining = (total - done) * mean of the last k steps. A long series is cut into ranges, each of which is handed the
    number of steps and the last k - 1 of those before it."""
    rows = sliced(df, [key], rising(*order))
    rows = carried(rows, [key], "_slice", fields(rows), {"done": F.lit(1).cast("long")})
    rows = recent(rows, [key], F.col(seconds).cast("double"), k, "_last")
    known = F.filter(F.transform("_last", lambda x: x["v"]), lambda v: v.isNotNull())
    out = rows.withColumn("recent", F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)))
    out = out.withColumn("remaining", F.greatest(F.lit(0), F.lit(total) - F.col("done")) * F.col("recent"))
    return out.drop("_last", "_o", "_slice", "_cut")


def choose_by_mode(df: DataFrame, group: str, mode: Column, score: str, key: str, seed: int) -> DataFrame:
    """One row of each group: the best, or by digest one of the top 3, of the top 5, or of a pool of at least 3 (a tenth). A large
    group is ranked by ranges, like any other order."""
    size = df.groupBy(group).agg(F.count("*").alias("_size"))
    ranked = score_rank(df.withColumn("mode", mode), [group], score, [key], "rank").join(size, group)
    pool = F.when(F.col("mode") == "best", 1).when(F.col("mode") == "top3", 3).when(F.col("mode") == "top5", 5).otherwise(F.greatest(F.lit(3), F.floor(F.col("_size") / 10)))
    pool = F.least(pool, F.col("_size"))
    pick = F.conv(F.substring(hash_rank(seed, F.col(group)), 1, 8), 16, 10).cast("long") % pool + 1
    return ranked.where(F.col("rank") == pick).drop("_size")


def select_candidate(df: DataFrame, sample: str, candidate: str, components: list[str], weights: dict[str, float], conditions: list[str], seed: int) -> DataFrame:
    """The best candidate of each sample under each condition: `full`, `no_<component>` (its weight 0, the others as they
    are) and `random` (least digest, no score). Ties go to the least candidate.

    Each condition is an aggregate of its own over one grouping, so a sample's candidates are never gathered.
    """
    aggs = []
    for cond in conditions:
        if cond == "random":
            order = F.struct(hash_rank(seed, F.col(sample), F.col(candidate)).alias("d"), F.col(candidate).alias("c"))
            aggs.append(F.min_by(F.struct(F.lit(cond).alias("condition"), F.col(candidate), F.lit(None).cast("double").alias("final_score")), order).alias(cond))
        else:
            score = reduce(lambda a, b: a + b, [F.lit(0.0 if cond == f"no_{c}" else weights[c]) * F.col(c) for c in components])
            order = first_of(score, candidate)
            aggs.append(F.min_by(F.struct(F.lit(cond).alias("condition"), F.col(candidate), score.alias("final_score")), order).alias(cond))
    g = df.groupBy(sample).agg(*aggs)
    return g.select(sample, F.explode(F.array(*conditions)).alias("_c")).select(sample, "_c.condition", f"_c.{candidate}", "_c.final_score")


#: What each part of the guidance weighs in the adjustment of a score.
GUIDANCE_WEIGHTS = {"quota_bonus": 0.06, "domain_repeat_penalty": -0.08, "background_repeat_penalty": -0.18, "recent_history_penalty": -0.10, "coarse_domain_penalty": -0.30}


def usage_guidance(df: DataFrame, obj: str, domain: str, background: str, order: list[str], quota: int, allowed: dict | None = None, others: int = 5, memory: int = 4, coarse: Column | None = None) -> DataFrame:
    """What the uses committed before each row tell of its object, and the adjustment of a score that follows.

    Rows are uses in the order of their commits. used: earlier uses of the object; remaining_quota and quota_bonus: what
    the quota leaves, and its share; domain_repeat_penalty: earlier uses in the row's domain by the number of domains
    that are allowed with it (`allowed`, else `others`); background_repeat_penalty: earlier uses on the row's background;
    recent_history_penalty: 1 if the object is among the last `memory` commits, of whatever object; coarse_domain_penalty: a
    column of the caller's, or 0; adjustment: their weighted sum.

    Counts of an object are running sums over ranges of its uses, so an object with half of all uses is spread over tasks;
    the memory goes through ranges of all commits, each of which gets the last ones of those before it.
    """
    one = F.lit(1).cast("long")
    base = durable(df.withColumn("_o", rising(*order)))
    rows = placed(base, [obj], find_cuts(base, [obj]))
    rows = carried(rows, [obj], "_slice", fields(rows), {"used": one, "_domain": one, "_background": one}, {"_domain": [domain], "_background": [background]}).drop("_slice", "_cut")
    commits = find_cuts(base, [])
    rows = seen_lately(placed(rows, [], commits), [], F.col(obj), memory, "_memory", placed(base, [], commits))
    most = F.lit(others)
    for value, n in (allowed or {}).items():
        most = F.when(F.col(domain) == value, F.lit(n)).otherwise(most)
    rows = rows.withColumn("used", F.col("used") - 1).withColumn("remaining_quota", F.greatest(F.lit(0), F.lit(quota) - F.col("used")))
    out = rows.withColumns(
        {
            "quota_bonus": F.col("remaining_quota") / F.lit(float(max(1, quota))),
            "domain_repeat_penalty": (F.col("_domain") - 1) / most,
            "background_repeat_penalty": (F.col("_background") - 1).cast("double"),
            "recent_history_penalty": F.col("_memory").cast("double"),
            "coarse_domain_penalty": F.lit(0.0) if coarse is None else coarse,
        }
    )
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in GUIDANCE_WEIGHTS.items()])
    return out.withColumn("adjustment", total).drop("_domain", "_background", "_memory", "_o", "_slice", "_cut")


def latest(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def attempts(df: DataFrame, job: str, order: list[str], ts: str) -> DataFrame:
    """Adds attempt (1, 2, ...) and seconds to the next row of the job (null for the last); the rows of one job are cut into ranges."""
    rows = sliced(df, [job], rising(*order))
    rows = carried(rows, [job], "_slice", fields(rows), {"attempt": F.lit(1).cast("long")})
    rows = following(rows, [job], F.unix_micros(ts), "_next")
    return rows.withColumn("seconds", (F.col("_next.v") - F.unix_micros(ts)) / 1e6).drop("_next", "_o", "_slice", "_cut")
