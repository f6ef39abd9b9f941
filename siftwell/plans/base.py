"""Registry of queries and the tables and features that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def doc_features(t: Tables) -> DataFrame:
    """doc_id, lang, source, text_hash, n_words, n_chars, variety (distinct words / words), digits (share of characters)."""
    words = F.split("text", " ")
    return t.documents.select(
        "doc_id", "lang", "source", F.sha2("text", 256).alias("text_hash"), F.size(words).cast("long").alias("n_words"), "n_chars",
        (F.size(F.array_distinct(words)) / F.size(words)).alias("variety"),
        ((F.length("text") - F.length(F.translate("text", "0123456789", ""))) / F.greatest(F.lit(1), F.length("text"))).alias("digits"),
    )


FEATURES = """
    SELECT doc_id, lang, source, sha256(text) AS text_hash, len(w)::BIGINT AS n_words, n_chars,
           len(list_distinct(w))::DOUBLE / len(w) AS variety,
           length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(1, length(text)) AS digits
    FROM (SELECT *, string_split(text, ' ') AS w FROM documents)"""
#: column -> (weight, small is hard)
HARDNESS = {"n_words": (0.4, True), "variety": (0.35, True), "digits": (0.25, False)}


def norm_sql(col: str, invert: bool, over: str = "") -> str:
    lo, hi = f"min({col}) OVER ({over})", f"max({col}) OVER ({over})"
    part = f"({col} - {lo})::DOUBLE / ({hi} - {lo})"
    return f"CASE WHEN {hi} = {lo} THEN 0.5 ELSE {f'1 - {part}' if invert else part} END"


SCORED = f"""
    SELECT *, round({' + '.join(f'{w} * ({norm_sql(c, i)})' for c, (w, i) in HARDNESS.items())}, 9) AS score
    FROM ({FEATURES})"""


def hash_sql(*parts) -> str:
    return f"sha256({' || chr(124) || '.join(str(p) for p in parts)})"


def group_hash(df: DataFrame) -> DataFrame:
    """Adds sim_group: the text hash where it stands more than once, else null."""
    n = df.groupBy("text_hash").agg(F.count("*").alias("_n"))
    return df.join(n, "text_hash").withColumn("sim_group", F.when(F.col("_n") > 1, F.col("text_hash"))).drop("_n")


GROUPED = f"SELECT *, CASE WHEN count(*) OVER (PARTITION BY text_hash) > 1 THEN text_hash END AS sim_group FROM ({SCORED})"


def allocate_sql(source: str, key: str, weight: str, n: str, by: str = "") -> str:
    """SQL of the largest-remainder shares; source has a row for each key."""
    over = f"PARTITION BY {by}" if by else ""
    return f"""
    SELECT *, (f + CASE WHEN row_number() OVER ({over} ORDER BY round(e - f, 9) DESC, {key} DESC) <= {n} - sum(f) OVER ({over}) THEN 1 ELSE 0 END)::BIGINT AS quota
    FROM (SELECT *, floor(e) AS f FROM (SELECT *, {n} * {weight}::DOUBLE / sum({weight}) OVER ({over}) AS e FROM ({source})))"""
