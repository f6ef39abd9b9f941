"""Sinks: write-once tables, ordered fixed-precision CSV, stage logs, exactly-once appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType


def content_digest(df: DataFrame) -> str:
    """A digest of the rows as a bag: number, and xor and sum of row hashes. It does not depend on their order."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    h = F.sha2(F.concat_ws("\x1f", *cols), 256)
    low, high = (F.conv(F.substring(h, k, 15), 16, 10).cast("long") for k in (1, 16))
    row = df.select(low.alias("a"), high.alias("b")).agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("b").cast(DecimalType(38, 0)))).first()
    return f"{row[0]}-{row[1]}-{row[2]}"


def write_once(df: DataFrame, path: str) -> bool:
    """Writes df unless the same rows are there already (False). Other rows at the path are an error."""
    if _exists(df.sparkSession, path):
        held = df.sparkSession.read.schema(df.schema).parquet(path)
        if content_digest(held) != content_digest(df):
            raise FileExistsError(f"{path} holds other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, decimals: int, order: list) -> None:
    """CSV with a header, rows in order and all fractions with a fixed number of decimals."""
    fixed = [F.format_string(f"%.{decimals}f", F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema]
    exact = [F.when(F.col(f.name).isNotNull(), c).alias(f.name) for f, c in zip(df.schema, fixed)]
    df.orderBy(*order).select(*exact).write.option("header", True).csv(path)


def stage_log(stages: dict[str, DataFrame]) -> DataFrame:
    """Outcomes of several stages as one table; columns that a stage lacks are null."""
    parts = [df.withColumn("stage", F.lit(name)) for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def append_new(batch: DataFrame, path: str, keys: list[str], by: str | None = None) -> None:
    """Appends the rows whose keys are not at the path yet; to be used by foreachBatch, where a batch can come twice.

    by: a column, such as the day, that a key never changes; the sink is partitioned by it, and a batch then reads only the
    partitions that it has rows for, not the whole sink.
    """
    rows = batch.dropDuplicates(keys)
    if _exists(batch.sparkSession, path):
        held = batch.sparkSession.read.schema(batch.schema).parquet(path)
        if by is not None:
            held = held.where(F.col(by).isin([r[0] for r in batch.select(by).distinct().collect()]))  # days of a batch
        rows = rows.join(held.select(*keys), keys, "left_anti")
    writer = rows.write.mode("append")
    (writer if by is None else writer.partitionBy(by)).parquet(path)
