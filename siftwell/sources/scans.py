"""Scans of files, images, label texts, CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import extension, stem


def scan_files(spark: SparkSession, root: str, exts: list[str]) -> DataFrame:
    """(path, stem, extension, folder, size, modified) of the files under root with these extensions, in any case; contents are
    not read, and other files are left out when the folder is listed."""
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in exts]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(any_case)}}}")
    files = reader.load(root).select("path", "length", "modificationTime")
    out = files.select("path", stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("extension"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(F.col("extension").isin([e.lower() for e in exts]))


def scan_images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Decoded images (path, height, width, channels, data as BGR bytes), and rejects (path, reason)."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root).select("image.*")
    good = rows.where("nChannels > 0").select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")
    return good, rows.where("nChannels <= 0").select(F.col("origin").alias("path"), F.lit("undecodable").alias("reason"))


def scan_labels(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem, line): the non-blank lines of text files."""
    rows = spark.read.option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    return rows.where("line <> ''").select("path", stem(F.col("path")).alias("stem"), "line")


def read_table_csv(spark: SparkSession, path: str, schema: StructType, exact: bool = True) -> DataFrame:
    """Typed CSV whose header must be the schema's columns in order (exact) or hold them all. A byte-order mark is
    skipped; values that do not parse are an error."""
    header = spark.read.option("header", True).csv(path).columns
    if exact and header != schema.names:
        raise ValueError(f"header {header} is not {schema.names}")
    if missing := set(schema.names) - set(header):
        raise ValueError(f"columns {sorted(missing)} are missing")
    typed = StructType([schema[c] if c in schema.names else StructField(c, StringType()) for c in header])
    return spark.read.schema(typed).option("header", True).option("mode", "FAILFAST").csv(path).select(*[f"`{c}`" for c in schema.names])


def read_manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines by a fixed schema; blank lines are skipped, broken ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
