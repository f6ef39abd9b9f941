"""Filters of a fixed size that tell which texts a later step can do without."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import forget, lean
from .wordhash import press_bytes

#: Numbers of a row in which arrays reach the driver.
BLOCK = 4096
#: Bits of a filter; their number is fixed, so a filter lets more through the larger the table is.
FILTER_BITS = 1 << 24


def gathered(blocks: DataFrame, n: int, kind: type) -> np.ndarray:
    """An array of n numbers from rows (block, data) of BLOCK numbers each; missing blocks are 0."""
    out = np.zeros(n, kind)
    for r in blocks.collect():  # n / BLOCK rows at most
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["data"], kind)
    return out


def slot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).alias("s")


def bit_filter(slots: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with those of the column s set."""
    bits = slots.groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(BLOCK, np.int64)
        out[table.column("w").to_numpy() % BLOCK] = table.column("b").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return gathered(bits.withColumn("block", F.expr(f"w div {BLOCK}").cast("int")).groupBy("block").applyInArrow(fill, "block int, data binary"), FILTER_BITS // 64, np.int64)


def holds(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return bits[s >> 6].view(np.uint64) >> (s & 63).astype(np.uint64) & np.uint64(1) == 1


def inside_filter(batch: pa.RecordBatch, bits: np.ndarray, inside: bool = True) -> pa.RecordBatch:
    """The rows of a batch whose slot s is in the filter, or those that are not."""
    return batch.filter(pa.array(holds(bits, batch.column("s").to_numpy()) == inside))


def pressed(rows: DataFrame, bits: np.ndarray, level: int = 1) -> DataFrame:
    """Of the rows (id, h, .., text) those whose (id, h) are in the filter, their text packed."""
    mask = rows.sparkSession.sparkContext.broadcast(bits)
    rest = [c for c in rows.columns if c != "text"]

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            part = inside_filter(batch, mask.value)
            packed = [press_bytes(x, level) for x in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(packed, pa.binary())], names=[*rest, "packed"])

    fields = [*[rows.schema[c] for c in rest], StructField("packed", BinaryType())]
    return rows.select(*rest, "text", slot("id", "h")).mapInArrow(lean(press), StructType(fields))
