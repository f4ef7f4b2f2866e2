"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: [\x20\x09-\x0D], as the contracts define white space.
BLANKS = " \t\n\x0b\x0c\r"
#: What a null doc_id counts as: behind every other.
LAST_ID = 2**63 - 1


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(column, UPPER, LOWER)


def order_id(column: Column) -> Column:
    """doc_id as it is ordered and grouped: rows without one are one document behind all others."""
    return F.coalesce(column.cast("long"), F.lit(LAST_ID))


def shown_id(column: Column) -> Column:
    """The doc_id of an `order_id`."""
    return F.when(column != LAST_ID, column)


def content_keys(column: Column, names: tuple[str, str]) -> list[Column]:
    """Two independent 64-bit hashes: together 128 bits, so that equal keys mean equal text also over 10^12 rows."""
    return [F.xxhash64(column).alias(names[0]), F.xxhash64(F.lit(1), column).alias(names[1])]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and no lost executor takes it away.

    `instead_of`: an earlier result of this function that nothing needs any more once `df` is written; its folder goes.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    if instead_of is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(instead_of.stored_in)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    back = spark.read.schema(df.schema).parquet(folder)
    back.stored_in = folder
    return back


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches to about `most_bytes` of the column `text` (one row at least), so memory doesn't follow batch sizes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 64
        yield batch.slice(start)


class Marked:
    """A set of keys as bits, with room for 16 bits a key and never over 16 MB. What isn't in the set may seem so."""

    def __init__(self, found: DataFrame, key: str, most_bits: int = 1 << 27):
        bits = min(most_bits, max(1 << 16, 1 << (16 * found.count()).bit_length()))
        self.places = bits // 64
        place = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(self.places - 1))
        bit = F.expr(f"shiftleft(1L, CAST({key} & 63 AS int))")
        rows = found.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.bits = np.zeros(self.places, np.uint64)
        self.bits[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        return (self.bits[(found >> np.uint64(6)) & np.uint64(self.places - 1)] >> (found & np.uint64(63))) & np.uint64(1) != 0
