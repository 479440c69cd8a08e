"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A broadcast made by this subpackage never exceeds this many bytes.
BROADCAST_BYTES = 16 << 20


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, lower-cased.

    ``lower`` does just that to pure ASCII and is many times faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder; lost executors don't lose it."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set, a session of one machine gets a temporary one; a cluster raises ``ValueError``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that no DataFrame needs any more: it does so when the driver's JVM
    collects its garbage, which may be long after the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_digests(df: DataFrame) -> list[Column]:
    """128 bits of all columns of a row, as two longs: what tells rows apart that have no key. Nulls count."""
    values = [F.map_entries(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema.fields]
    told = [x for v in values for x in (v.isNull(), v)]
    return [F.xxhash64(F.lit(seed), *told) for seed in (1, 2)]


def slices(batch: pa.RecordBatch, column: int, most_rows: int = 256, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``most_rows`` rows and about ``most_bytes`` of a column (text, binary or lists), one row at
    least: bounds what is made of a batch at a time."""
    x = batch.column(column)
    ends = x.offsets.to_numpy() if isinstance(x, pa.ListArray) else np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type) else np.int32, len(x) + 1 + x.offset)[x.offset :] if len(x) else [0]
    start = 0
    while start < batch.num_rows:
        stop = start + 1
        while stop < batch.num_rows and stop - start < most_rows and ends[stop + 1] - ends[start] <= most_bytes:
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

