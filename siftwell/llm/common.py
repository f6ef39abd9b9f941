"""What the training-data operators share: reading, durable cuts of the lineage, Arrow helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \x09-\x0D. bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\f\r"
#: Rows of texts that go to a task's Python worker at a time.
BATCH_ROWS = 1000
#: Bytes that the JVM puts into such a batch, one row at least.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: later steps survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the table: the join is shuffled and sorted. Else Spark may take a table that its file
    or its shuffle makes look small, collect it in the driver and copy it whole to every executor."""
    return df.hint("merge")


def shrink_heaps(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect all garbage, after which they hand the heap they no longer need back to the system.

    A JVM keeps what earlier jobs have made its heap grow to, up to its limit, beside the Python workers of later ones. One
    task for each core, all at once, reaches every executor; a JVM set not to collect on demand goes on as it is.
    """
    n = spark.sparkContext.defaultParallelism
    collect = F.expr("java_method('java.lang.System', 'gc')").alias("gc")
    spark.range(0, n, 1, n).select(collect).write.format("noop").mode("overwrite").save()


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of docs: other columns, whatever their names, play no part; null text is empty.

    Tasks get texts in batches of a few MB: unless the session says otherwise, a batch has BATCH_ROWS rows and about BATCH_BYTES at most.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").startswith(str(64 << 20)):  # Spark's default
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow over (id, text): make() runs once a task; what it returns gets the ids and texts (bytes) of about a MB at a
    time. keeps: make() uses what remembered() has kept in the worker; else that is let go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = arrow_schema(schema)
        if keeps:
            give_back()
        else:
            forget()
        step = make()
        for batch in batches:
            for part in small_parts(batch, 1 << 20):
                out = step(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.select("id", "text").mapInArrow(lean(run), schema)


def small_parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of about `most` bytes of text or one row."""
    sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string of plain types and arrays of them."""
    fields = []
    for item in ddl.split(","):
        name, kind = item.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(pa.field(name, pa.list_(_ARROW[inner]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


def remembered(name: str, make: Callable):
    """An object that a worker process keeps from one task to the next."""
    memory = sys.modules.setdefault("_siftwell_memory", types.ModuleType("_siftwell_memory"))
    if not hasattr(memory, name):
        setattr(memory, name, make())
    return getattr(memory, name)


def forget() -> None:
    """Lets go of what earlier tasks have kept in this worker, and hands free memory back to the system."""
    sys.modules.pop("_siftwell_memory", None)
    give_back()


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow, which hands its memory back when it has ended: the worker may wait for long after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Hands free memory back to the system: workers live on from stage to stage, beside each other and a JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
        if trim is not None:
            trim(0)
