"""Order within groups without gathering a group: ranges cut at quantiles of a sample, and sums and last states that are carried
from range to range.

An order is a struct column `_o` whose fields compare ascending (negate a number to make it fall). Its last field should tell
rows apart, so that equal scores are split too. A group that is rare in the sample is one range; no range of a common group
holds much more than PER_RANGE / SAMPLE of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .durable import durable

#: Rows of the sample (of distinct orders) and of those that make a range: there are 2048 cuts of all groups together at most
#: (about: the sample is drawn by a hash), and that is what is broadcast. LEAST: rows of a range; smaller groups are one range.
SAMPLE, PER_RANGE, LEAST = 65536, 32, 1024


def falling(score: str, *ties: Column | str) -> Column:
    """The order of falling score (nulls, then NaN, last), then ties."""
    return F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), *[(F.col(t) if isinstance(t, str) else t).alias(f"t{i}") for i, t in enumerate(ties)])


def rising(*cols: str) -> Column:
    return F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(cols)])


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def _renamed(by: list[str], mark: str) -> tuple[list[Column], list[str]]:
    names = [f"_{mark}{i}" for i in range(len(by))]
    return [F.col(c).alias(n) for c, n in zip(by, names, strict=True)], names


@dataclass
class Cuts:
    """Where the ranges of each group end: rows of (group, JSON of the cuts), the fields of the group, the type of the order."""

    held: list
    group: list[StructField]
    kind: str


def find_cuts(rows: DataFrame, by: list[str]) -> Cuts:
    """Cuts of rows (with `_o`, the order), which are read twice: for their number and for the sample. The sample is drawn by a hash of
    the order; each PER_RANGE-th of a group's sampled orders is a cut, or as many more as make LEAST rows."""
    every = max(1, rows.count() // SAMPLE)
    some = rows.select(*by, "_o").where(F.pmod(F.xxhash64("_o", *by), F.lit(every)) == 0)
    step = max(PER_RANGE, -(-LEAST // every))
    keys, names = _renamed(by, "c")
    cuts = some.select(*keys, "_o").groupBy(*names).agg(F.array_sort(F.collect_set("_o")).alias("_all")).where(F.size("_all") > step)
    cuts = cuts.select(*names, F.to_json(F.filter("_all", lambda _, i: (i + 1) % step == 0), {"ignoreNullFields": "false"}).alias("_json"))
    return Cuts(cuts.collect(), cuts.schema.fields[:-1], rows.schema["_o"].dataType.simpleString())  # SAMPLE / PER_RANGE cuts in all


def placed(rows: DataFrame, by: list[str], cuts: Cuts) -> DataFrame:
    """rows with `_slice`, the number of its range within `by` (every row of an earlier range comes before), and `_cut`: whether its
    group has several. A row finds its range by halving."""
    if not cuts.held:
        return rows.withColumns({"_slice": F.lit(0), "_cut": F.lit(False)})
    table = F.from_json(F.lit(f"[{','.join(r['_json'] for r in cuts.held)}]"), f"array<array<{cuts.kind}>>")  # a constant of the plan: not copied to the rows
    if by:
        known = [(*r[:-1], i) for i, r in enumerate(cuts.held)]
        known = rows.sparkSession.createDataFrame(known, StructType([*cuts.group, StructField("_g", IntegerType())]))
        names = [f.name for f in cuts.group]
        rows = rows.join(F.broadcast(known), _same(by, names), "left").drop(*names)
    else:
        rows = rows.withColumn("_g", F.lit(0))
    powers = F.array(*[F.lit(1 << k) for k in reversed(range((2 * (SAMPLE // PER_RANGE)).bit_length()))])
    step = lambda low, k: F.when(F.get(F.get(table, F.col("_g")), low + k - 1) <= F.col("_o"), low + k).otherwise(low)
    place = F.when(F.col("_g").isNull(), F.lit(0)).otherwise(F.aggregate(powers, F.lit(0), step))
    return rows.withColumns({"_slice": place, "_cut": F.col("_g").isNotNull()}).drop("_g")


def sliced(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """df with `_o`, the order, and its ranges. df is written once, since it is read several times."""
    rows = durable(df.withColumn("_o", order))
    return placed(rows, by, find_cuts(rows, by))


def fields(df: DataFrame, name: str = "_o") -> list[Column]:
    """The fields of a struct column, to sort by: Spark sorts plain columns faster than structs."""
    return [F.col(f"{name}.{f}") for f in df.schema[name].dataType.names]


def carried(rows: DataFrame, by: list[str], slice_: str, order: list, sums: dict[str, Column], within: dict[str, list[str]] | None = None) -> DataFrame:
    """rows with running sums, each row's own value included, over the order within `by`; within: name -> more columns of the
    groups that a sum is kept for.

    A sum is what earlier slices add up to, one number for each slice, plus the sum within the slice; slices of one `by` are
    therefore summed in different tasks.
    """
    held = rows.withColumns({f"_v{i}": c for i, c in enumerate(sums.values())})
    kinds: dict[tuple, list[tuple[str, str]]] = {}
    for i, name in enumerate(sums):
        kinds.setdefault(tuple((within or {}).get(name, ())), []).append((name, f"_v{i}"))
    out = held
    for k, (more, named) in enumerate(kinds.items()):
        inner = Window.partitionBy(*by, slice_, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"_r{v}": F.sum(v).over(inner) for _, v in named})
    for k, (more, named) in enumerate(kinds.items()):
        keys, names = _renamed([*by, *more, slice_], f"k{k}_")
        parts = (held.where("_cut") if "_cut" in held.columns else held).groupBy(*by, *more, slice_).agg(*[F.sum(v).alias(v) for _, v in named]).select(*keys, *[v for _, v in named])
        earlier = Window.partitionBy(*names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
        before = parts.select(*names, *[F.sum(v).over(earlier).alias(f"_b{v}") for _, v in named]).where(f"_b{named[0][1]} is not null")
        before = before if more or "_cut" not in held.columns else F.broadcast(before)  # a row for each cut at most
        out = out.join(before, _same([*by, *more, slice_], names), "left")
        out = out.withColumns({name: F.coalesce(F.col(f"_b{v}") + F.col(f"_r{v}"), F.col(f"_r{v}")) for name, v in named}).drop(*names)
    values = [f"_v{i}" for i in range(len(sums))]
    return out.drop(*[f"{p}{v}" for v in values for p in ("", "_b", "_r")])


def running(df: DataFrame, by: list[str], order: Column, sums: dict[str, Column]) -> DataFrame:
    """df with running sums over the order within `by`, each row's own value included; no task holds a whole group."""
    rows = sliced(df, by, order)
    return carried(rows, by, "_slice", fields(rows), sums).drop("_o", "_slice", "_cut")


def tails(rows: DataFrame, by: list[str], value: Column, k: int, name: str, source: DataFrame | None = None) -> DataFrame:
    """rows of sliced() with `name`: an array of the last k values (structs of one field v) of earlier slices, in their order.

    Each slice hands on its last k; those of the k slices before are enough, since none is empty. They are taken from `source`, the
    same rows in a plan that is cheaper to run, if there is one.
    """
    back = Window.partitionBy(*by, "_slice").orderBy(*[c.desc() for c in fields(rows)])
    last = (rows if source is None else source).where("_cut").withColumns({"_v": value, "_back": F.row_number().over(back)}).where(F.col("_back") <= k)
    keys, names = _renamed([*by, "_slice"], "k")
    lists = last.groupBy(*by, "_slice").agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col("_v").alias("v")))).alias("_t")).select(*keys, "_t")
    w = Window.partitionBy(*names[:-1]).orderBy(names[-1]).rowsBetween(-k, -1)
    every = F.transform(F.flatten(F.collect_list("_t").over(w)), lambda x: F.struct(x["v"].alias("v")))
    before = lists.select(*names, last_of(every, k).alias(name))
    none = F.array().cast(before.schema[name].dataType)
    return rows.join(F.broadcast(before), _same([*by, "_slice"], names), "left").drop(*names).withColumn(name, F.coalesce(name, none))  # k values for each range at most


def last_of(array: Column, k: int) -> Column:
    """The last k elements of an array, or all."""
    return F.when(F.size(array) > k, F.slice(array, -k, k)).otherwise(array)


def recent(rows: DataFrame, by: list[str], value: Column, k: int, name: str) -> DataFrame:
    """rows of sliced() with `name`: an array of the values (structs of one field v) of the last k rows, each row itself included."""
    held = tails(rows.withColumn("_own", F.struct(value.alias("v"))), by, value, k - 1, "_tail") if k > 1 else rows.withColumns({"_own": F.struct(value.alias("v")), "_tail": F.array(F.struct(value.alias("v")))}).withColumn("_tail", F.filter("_tail", lambda x: F.lit(False)))
    w = Window.partitionBy(*by, "_slice").orderBy(*fields(held)).rowsBetween(-(k - 1), 0)
    return held.withColumn("_near", F.collect_list("_own").over(w)).withColumn(name, last_of(F.concat("_tail", "_near"), k)).drop("_tail", "_near", "_own")


def seen_lately(rows: DataFrame, by: list[str], value: Column, k: int, name: str, source: DataFrame | None = None) -> DataFrame:
    """rows of sliced() with `name`: whether one of the k rows before each row has the same value. Only the first k rows of a slice
    look at what earlier slices hand on."""
    held = tails(rows.withColumn("_own", value), by, value, k, "_tail", source)
    w = Window.partitionBy(*by, "_slice").orderBy(*fields(held))
    held = held.withColumns({"_at": F.row_number().over(w), **{f"_l{j}": F.lag("_own", j).over(w) for j in range(1, k + 1)}})
    inside = reduce(lambda a, b: a | b, [(F.col("_at") > j) & F.col(f"_l{j}").eqNullSafe(F.col("_own")) for j in range(1, k + 1)])
    left = F.lit(k + 1) - F.col("_at")  # of the last k rows so many lie in earlier slices
    reach = F.when(F.size("_tail") > left, F.slice("_tail", -left, left)).otherwise(F.col("_tail"))
    outside = F.when(left > 0, F.exists(reach, lambda x: x["v"].eqNullSafe(F.col("_own")))).otherwise(F.lit(False))
    return held.withColumn(name, inside | outside).drop("_own", "_tail", "_at", *[f"_l{j}" for j in range(1, k + 1)])


def following(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """rows of sliced() with `name`: a struct of one field v, the value of the next row of the group; null for the last row."""
    held = rows.withColumn("_own", F.struct(value.alias("v")))
    keys, names = _renamed([*by, "_slice"], "k")
    first = held.where("_cut").groupBy(*by, "_slice").agg(F.min_by("_own", "_o").alias("_f")).select(*keys, "_f")
    after = first.select(*names, F.lead("_f").over(Window.partitionBy(*names[:-1]).orderBy(names[-1])).alias("_after"))
    w = Window.partitionBy(*by, "_slice").orderBy(*fields(held))
    out = held.withColumn("_lead", F.lead("_own").over(w)).join(F.broadcast(after), _same([*by, "_slice"], names), "left")  # a row for each range
    return out.withColumn(name, F.coalesce("_lead", "_after")).drop("_own", "_lead", "_after", *names)
