"""Quotas, schedules, assignments, splits and composed selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_rank
from .joins import exclude
from .durable import durable
from .windows import bucket_rank, digest_rank, hardness, keep_best, score_rank


def allocate(weights: DataFrame, key: str, weight: str, n: int | Column, by: list[str] | None = None) -> DataFrame:
    """Largest-remainder shares of n by weight; equal remainders go to the greater key. weights has a row for each key.

    With `by`, each group of keys shares n (which may be a column of it) for itself.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    groups = by or []
    total = F.sum(weight).over(Window.partitionBy(*groups))
    exact = n * F.col(weight) / total
    out = weights.withColumn("_e", F.when(total > 0, exact).otherwise(0.0)).withColumn("_f", F.floor("_e"))
    left = n - F.sum("_f").over(Window.partitionBy(*groups))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), F.desc(key)))
    return out.withColumn("quota", (F.col("_f") + F.when((rank <= left) & (total > 0), 1).otherwise(0)).cast("long")).drop("_e", "_f")


def expand_schedule(counts: DataFrame, by: str, count: str, seed: int) -> DataFrame:
    """(slot, by, nth): counts made into rows and shuffled by digest; slots are numbered 1, 2, ..."""
    rows = counts.where(F.col(count) > 0).select(by, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))).alias("nth"))
    rows = rows.withColumns({"_d": hash_rank(seed, F.col(by), F.col("nth")), "_all": F.lit(1)})
    return digest_rank(rows, ["_all"], "_d", "nth", "slot").select("slot", by, "nth")


def zip_schedule(columns: dict[str, tuple[DataFrame, str]], seed: int) -> DataFrame:
    """(slot, one column for each of `columns`): independent schedules of the same number of slots, zipped by slot.

    columns: name -> (a frame with a column of that name and a count of each value, the count's column). Each is made into
    rows and shuffled by a digest order of its own, so each value has exactly its count and columns do not depend on each other. Counts
    that add up to different numbers are an error.
    """
    sums = {name: counts.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col(count))), F.lit(0))).first()[0] for name, (counts, count) in columns.items()}
    if len(set(sums.values())) > 1:
        raise ValueError(f"schedules of different lengths: {sums}")
    parts = [expand_schedule(counts, name, count, seed + i).select("slot", name) for i, (name, (counts, count)) in enumerate(columns.items())]
    return reduce(lambda a, b: a.join(b, "slot"), parts)


def exchange(rows: DataFrame, slot: str, column: str, allowed: Column, seed: int, rounds: int = 6, fan: int = 8) -> DataFrame:
    """rows with values of `column` exchanged between rows so that `allowed`, a condition on a row, holds for each; every value keeps
    its count.

    In each round the rows that are not allowed, in a digest order of the round, are each offered `fan` allowed ones of another
    order, which no other is offered; it exchanges values with the first that leaves both allowed. Rows that are still not
    allowed after all rounds are an error.
    """
    ok = F.coalesce(allowed, F.lit(False))
    others = [c for c in rows.columns if c not in (slot, column)]
    now = durable(rows.withColumn("_ok", ok))
    for k in range(rounds):
        ill = now.where("not _ok").count()
        if not ill:
            return now.drop("_ok")
        dealt = digest_rank(now.withColumn("_d", hash_rank(seed, F.lit(k), F.col(slot))), ["_ok"], "_d", slot, "_n").where(F.col("_n") <= fan * ill)
        dealt = durable(dealt.withColumn("_pair", F.when(F.col("_ok"), F.floor((F.col("_n") - 1) / fan) + 1).otherwise(F.col("_n"))).select(slot, *others, column, "_ok", "_n", "_pair"))
        one, two = dealt.where("not _ok"), dealt.where("_ok")
        value = lambda df, name, *more: df.select("_pair", F.col(column).alias(name), *more)
        theirs = two.join(value(one, "_new"), "_pair").withColumn("_old", F.col(column)).withColumn(column, F.col("_new")).withColumn("_fits", ok).where("_fits").select(F.col(slot).alias("_slot"), "_pair", "_n", "_old", "_new")
        mine = one.drop("_n").join(theirs, "_pair").withColumn(column, F.col("_old")).withColumn("_fits", ok).where("_fits")
        best = mine.groupBy("_pair").agg(F.min(F.struct("_n", F.col(slot).alias("a"), F.col("_slot").alias("b"), F.col("_old").alias("va"), F.col("_new").alias("vb"))).alias("m"))
        swap = F.explode(F.array(F.struct(F.col("m.a").alias("s"), F.col("m.va").alias("v")), F.struct(F.col("m.b").alias("s"), F.col("m.vb").alias("v")))).alias("x")
        swapped = best.select(swap).select(F.col("x.s").alias(slot), F.col("x.v").alias("_new"), F.lit(True).alias("_swap"))
        moved = now.join(swapped, slot, "left").withColumn(column, F.when(F.col("_swap"), F.col("_new")).otherwise(F.col(column)))
        now = durable(moved.drop("_new", "_swap").withColumn("_ok", ok))
    if now.where("not _ok").isEmpty():
        return now.drop("_ok")
    raise ValueError(f"rows that no exchange made allowed in {rounds} rounds")


def object_quota(df: DataFrame, key: str, n: int, seed: int, low: int = 5, high: int = 7) -> DataFrame:
    """Uses of each object when n are dealt out evenly in the order of a digest, under a ceiling between low and high."""
    ranked = digest_rank(df.select(key).withColumns({"_d": hash_rank(seed, F.col(key)), "_all": F.lit(1)}), ["_all"], "_d", key, "rank")
    k = df.agg(F.count("*").alias("_k"))
    ceiling = F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(F.lit(n) / F.col("_k"))))
    even = F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("rank") <= F.lit(n) % F.col("_k"), 1).otherwise(0)
    return ranked.crossJoin(F.broadcast(k)).select(key, "rank", F.least(ceiling, even).cast("long").alias("quota"))  # k is one row


def drop_variants(df: DataFrame, origin: str, signature: str, key: str) -> DataFrame:
    """The least key of each (origin, signature)."""
    return df.groupBy(origin, signature).agg(F.min(key).alias(key))


def promote(scores: DataFrame, kept: DataFrame, removed: DataFrame, by: str, key: str, group: str, score: str) -> DataFrame:
    """Replacements: in each stratum as many unselected rows as were removed, best score first, one of each similarity
    group, none of a group that a kept row stands in."""
    need = removed.groupBy(by).agg(F.count("*").alias("quota"))
    selected = kept.select(key).unionByName(removed.select(key))
    pool = exclude(scores, selected, key)
    taken = kept.where(F.col(group).isNotNull()).select(group)
    pool = pool.join(taken.distinct(), group, "left_anti")
    pool = keep_best(pool, group, score, key).where("not removed").drop("removed")
    ranked = score_rank(pool, [by], score, [F.col(key)], "rank")
    return ranked.join(need, by).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def change_log(kept: DataFrame, promoted: DataFrame, removed: DataFrame, cols: list[str]) -> DataFrame:
    parts = [df.select(*cols, F.lit(name).alias("action")) for name, df in (("kept", kept), ("promoted", promoted), ("removed", removed))]
    return reduce(DataFrame.unionByName, parts)


def select_hard(df: DataFrame, key: str, by: str, group: str, weights: dict, n: int, seed: int = 0) -> DataFrame:
    """The whole selection of hard samples: score, quotas by stratum, top rows, best of each similarity group,
    replacements, and a log of what was kept, promoted and removed with the final rank in its stratum (0: removed). The features are
    written once, so that the steps do not measure the rows again."""
    scored = hardness(durable(df.select(key, by, group, *weights)), weights).select(key, by, group, F.round("score", 9).alias("score"))
    quotas = allocate(scored.groupBy(by).agg(F.count("*").alias("w")), by, "w", n).select(by, "quota")
    scored = durable(scored)
    ranked = score_rank(scored, [by], "score", [F.col(key)], "rank")
    top = durable(ranked.join(quotas, by).where(F.col("rank") <= F.col("quota")).drop("rank", "quota"))
    marked = durable(keep_best(top, group, "score", key))
    kept, removed = marked.where("not removed"), marked.where("removed")
    promoted = promote(scored, kept, removed, by, key, group, "score")
    log = change_log(kept, promoted, removed, [key, by, "score"])
    log = durable(log)
    stays = score_rank(log.where("action <> 'removed'"), [by], "score", [F.col(key)], "rank")
    return stays.unionByName(log.where("action = 'removed'").withColumn("rank", F.lit(0).cast("long")))


def stratified_split(df: DataFrame, by: str, key: str, targets: dict[str, int], seed: int) -> DataFrame:
    """(key, by, split): train, val, test and reserve with exact counts where the rows allow.

    Quotas follow each stratum's share of rows, rounded half to even; train is what val and test leave, up to its
    target, and test is filled up from what is left over. Order within a stratum is that of a digest.
    """
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    total, want = F.sum("n").over(Window.partitionBy()), sum(targets.values())
    scale = F.least(F.lit(1.0), total / F.lit(float(want)))
    share = lambda name: F.bround(scale * targets[name] * F.col("n") / total).cast("long")
    q = n.withColumns({name: share(name) for name in ("val", "test")})
    q = q.withColumn("train", F.least(share("train"), F.col("n") - F.col("val") - F.col("test")))
    ranked = digest_rank(df.select(key, by).withColumn("_d", hash_rank(seed, F.col(key))), [by], "_d", key, "_r")
    r, a, b = F.col("_r"), F.col("val") + F.col("test"), F.col("val") + F.col("test") + F.col("train")
    placed = ranked.join(q.drop("n"), by).withColumn("split", F.when(r <= F.col("val"), "val").when(r <= a, "test").when(r <= b, "train").otherwise("reserve"))
    placed = placed.select(key, by, "_d", "split")
    rest = digest_rank(placed.where("split = 'reserve'").withColumn("_all", F.lit(1)), ["_all"], "_d", key, "_rest").select(key, F.col("_rest"))
    have = placed.agg(F.count_if(F.col("split") == "test").alias("_have"))
    filled = placed.join(rest, key, "left").crossJoin(F.broadcast(have))  # have is one row
    more = (F.col("split") == "reserve") & (F.col("_rest") <= F.lit(targets["test"]) - F.col("_have"))
    return filled.select(key, by, F.when(more, "test").otherwise(F.col("split")).alias("split"))


def split_conflicts(df: DataFrame, registry: DataFrame, origin: str) -> DataFrame:
    """Rows whose origin is registered to another split."""
    held = registry.select(origin, F.col("split").alias("registered")).distinct()
    return df.join(held, origin).where("split <> registered")


def leakage(df: DataFrame, digest: str, split: str) -> DataFrame:
    """(split_a, split_b, shared): contents that stand in both of two splits."""
    held = df.select(digest, split).distinct()
    a, b = held.withColumnRenamed(split, "split_a"), held.withColumnRenamed(split, "split_b")
    return a.join(b, digest).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


def assign_balanced(slots: DataFrame, objects: DataFrame, by: str, slot: str, background: str, obj: str, seed: int) -> DataFrame:
    """(slot, by, background, object): in each environment the slots, by digest of their background, take the objects in
    turn, so uses differ by one at most and no pair repeats while no background has more slots than there are objects."""
    ordered = slots.withColumn("_d", hash_rank(seed, F.col(background)))
    w = F.substring(F.col("_d"), 1, 3)
    ranked = bucket_rank(ordered, [by], w, [F.col("_d"), F.col(background), F.col(slot)], "_r")
    ring = digest_rank(objects.select(by, obj).withColumn("_d", hash_rank(seed, F.col(obj))), [by], "_d", obj, "_o").drop("_d")
    size = objects.groupBy(by).agg(F.count("*").alias("_k"))
    asked = ranked.join(size, by).withColumn("_o", (F.col("_r") - 1) % F.col("_k") + 1)
    return asked.join(ring, [by, "_o"]).select(slot, by, background, obj)


def rotate(slots: DataFrame, pool: DataFrame, by: str, slot: str, item: str, seed: int) -> DataFrame:
    """(slot, by, item, cycle): each cycle of a domain goes through its whole pool, in a digest order of its own. The rings of
    all cycles together have about as many rows as there are slots."""
    ranked = digest_rank(slots.withColumn("_d", hash_rank(seed, F.col(slot))), [by], "_d", slot, "_r").drop("_d")
    size = pool.groupBy(by).agg(F.count("*").alias("_k"))
    turns = slots.groupBy(by).agg(F.count("*").alias("_n")).join(size, by).select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / F.col("_k")) - 1)).alias("cycle"))
    rings = pool.select(by, item).join(turns, by).withColumn("_d", hash_rank(seed, F.col("cycle"), F.col(item)))
    rings = digest_rank(rings, [by, "cycle"], "_d", item, "_o").drop("_d")
    asked = ranked.join(size, by).withColumn("cycle", F.floor((F.col("_r") - 1) / F.col("_k"))).withColumn("_o", (F.col("_r") - 1) % F.col("_k") + 1)
    return asked.join(rings, [by, "cycle", "_o"]).select(slot, by, item, "cycle")


def prefilter(df: DataFrame, group: str, strict: Column, order: list, k: int) -> DataFrame:
    """k rows of each group: of the strict ones if there are k, else of all, strict ones first."""
    rows = df.withColumn("strict", F.coalesce(strict, F.lit(False)))
    w = Window.partitionBy(group).orderBy(F.desc("strict"), *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build_mixture(mix: DataFrame, rows: DataFrame, kind: str, key: str) -> DataFrame:
    """(experiment, kind, key): the rows of each kind that an experiment's row of the mixture table takes, by rank."""
    return rows.join(mix, kind).where(F.col("rank") <= F.col("take")).select("experiment", kind, key)


def check_mixture(mix: DataFrame, rows: DataFrame, kind: str, key: str) -> DataFrame:
    """(experiment, kind, reason, n): kinds of which an experiment has not the number of rows asked for (n: how many too many),
    and experiments with keys that stand more than once (n: how many keys)."""
    have = rows.groupBy("experiment", kind).agg(F.count("*").alias("_n"))
    short = mix.join(have, ["experiment", kind], "left").withColumn("n", F.coalesce("_n", F.lit(0)) - F.col("take")).where("n <> 0")
    twice = rows.groupBy("experiment", key).agg(F.count("*").alias("_n")).where("_n > 1").groupBy("experiment").agg(F.count("*").alias("n"))
    return short.select("experiment", kind, F.lit("count").alias("reason"), "n").unionByName(twice.select("experiment", F.lit(None).cast(dict(mix.dtypes)[kind]).alias(kind), F.lit("repeated_key").alias("reason"), "n"))


def background_pool(df: DataFrame, digest: str, key: str, real: DataFrame) -> DataFrame:
    """One row (the least key) of each content that no real row has."""
    return df.groupBy(digest).agg(F.min(key).alias(key)).join(real.select(digest).distinct(), digest, "left_anti")


def cover_sample(df: DataFrame, fields: list[str], seed: int, key: str) -> DataFrame:
    """The row of the least digest for each (field, value): together they touch every value."""
    d = F.struct(hash_rank(seed, F.col(key)).alias("d"), F.col(key).alias("k"))
    pairs = df.withColumn("_d", d).select("_d", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields])).alias("p"))
    return pairs.groupBy("p.f", "p.v").agg(F.min("_d").alias("_d")).select(F.col("_d.k").alias(key)).distinct()


def pick_cases(df: DataFrame, rules: list[tuple[str, Column, Column]], key: str) -> DataFrame:
    """(rule, key): for each rule (name, condition, score) the row of greatest score under its condition, without it if no
    row meets it; each row is taken once. Rules are few and part of the program."""
    out, used = [], []
    for name, condition, score in rules:
        pool = df.where(~F.col(key).isin(used)) if used else df
        best = pool.select(key, F.coalesce(condition, F.lit(False)).alias("_c"), score.alias("_s")).orderBy(F.desc("_c"), F.desc_nulls_last("_s"), key).limit(1).collect()
        if best:
            used.append(best[0][key])
            out.append((name, best[0][key]))
    return df.sparkSession.createDataFrame(out, f"rule string, {key} {dict(df.dtypes)[key]}")


def build_grid(conditions: DataFrame, seeds: DataFrame, contract: list[str]) -> DataFrame:
    """Condition x seed (both a program's own small tables) with job id, contract digest and the first job of that digest."""
    grid = conditions.crossJoin(seeds).withColumn("digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in contract], F.col("seed").cast("string")), 256))
    grid = grid.withColumn("job", F.concat_ws("_", "experiment", F.concat(F.lit("seed"), "seed")))
    first = grid.groupBy("digest").agg(F.min("job").alias("reuses"))
    return grid.join(first, "digest").withColumn("reuses", F.when(F.col("reuses") != F.col("job"), F.col("reuses")))


def check_grid(jobs: DataFrame, job: str, reuses: str, digest: str, dataset: str, denied: str = "#split=test") -> DataFrame:
    """(job, reason): job ids that stand more than once, jobs on data they must not see, and jobs that reuse one that is not there
    or is itself a reference (no_target) or that has another contract (other_contract)."""
    twice = jobs.groupBy(job).agg(F.count("*").alias("_n")).where("_n > 1").select(job, F.lit("repeated_job").alias("reason"))
    leaks = jobs.where(F.contains(F.lower(dataset), F.lit(denied.lower()))).select(job, F.lit("test_data").alias("reason"))
    target = jobs.where(F.col(reuses).isNull()).groupBy(F.col(job).alias(reuses)).agg(F.min(digest).alias("_d"))
    asked = jobs.where(F.col(reuses).isNotNull()).join(target, reuses, "left")
    wrong = F.when(F.col("_d").isNull(), "no_target").when(F.col("_d") != F.col(digest), "other_contract")
    return twice.unionByName(leaks).unionByName(asked.select(job, wrong.alias("reason")).where("reason is not null"))
