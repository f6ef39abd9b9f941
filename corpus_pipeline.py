"""A corpus pipeline: toxicity, line dedup, near-dedup on word shingles, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Further columns of documents, whatever their names, play no
part; an empty table gives an empty result. Before a stage the executors hand back the heap that earlier ones needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import lines, near, packing, queries, secrets, toxicity
from siftwell.llm.common import saved, shrink_heaps, shuffled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of labels.toxic scores under 0.5 stay, as they are. Rows are judged each: repeated rows and ids
    alike, a null text as an empty one, a null id like any other (it has no label)."""
    shrink_heaps(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~queries.held_out("id"))
    return toxicity.toxicity(docs, model, keep=tuple(COLUMNS)).where("score < 0.5").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are alike an earlier line go; every document stays, with the text that is left. Null and empty texts and rows
    without an id stay as they are; rows that repeat id and text are one document and lose the same lines."""
    shrink_heaps(spark)
    kept = lines.line_dedup(docs, carry=("text", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    return kept.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest doc_id, and of rows that share it the one with
    the least hash. Near copies are texts whose SimHash fingerprints (op1_simhash) differ in 2 bits or less, found by Golay keys,
    and those whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Rows with one doc_id and texts that are no near copies all stay, and so do those without a doc_id."""
    shrink_heaps(spark)
    rows, roots = near.near_rows(docs.where("doc_id is not null").select(COLUMNS), fingerprints=True)
    order = F.struct("doc_id", F.xxhash64(*COLUMNS).alias("hash"), "r")
    slim = rows.select("r", "node", order.alias("order")).join(shuffled(roots), "node", "left")
    slim = saved(slim.select("r", F.coalesce("root", "node").alias("root"), "order"))
    low = saved(slim.groupBy("root").agg(F.min("order").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"))  # so that the join of a hot root is split
    gone = saved(slim.join(shuffled(low), "root").where(F.col("r") != F.col("low.r")).select("r"))
    return rows.join(gone.hint("shuffle_hash"), "r", "left_anti").select(COLUMNS).union(docs.where("doc_id is null").select(COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; each secret in its text is replaced by the name of its kind. Null texts stay null."""
    shrink_heaps(spark)
    net = secrets.train(docs)
    mask = secrets.mask_column(net)
    text = F.when(F.col("text").isNotNull(), mask("text"))
    return docs.withColumn("masked", text).select("doc_id", F.col("masked").alias("text"), "lang", "source", F.coalesce(F.length("masked").cast("long"), F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their place in sequences of at most 1024 tokens. Null and empty texts are one piece with the end
    token; repeated rows are packed each."""
    shrink_heaps(spark)
    return packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_near),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # learned models, a tokenizer and best-fit placing are beyond SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
