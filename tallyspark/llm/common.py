"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_folder  # noqa: F401


#: Rows of an Arrow batch at most: a row may be a long document, and a task holds a batch several times over.
BATCH_ROWS, BATCH_CONF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean_batches(spark: SparkSession) -> None:
    """Let the session send at most BATCH_ROWS rows at a time to Python; a smaller setting of its own stays."""
    now = int(spark.conf.get(BATCH_CONF))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by the path that Spark's own reader opens."""
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, a cut table of a few narrow columns, marked for broadcast if it has at most ``rows`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory to the machine, as a task begins: a worker that Spark uses again would keep what earlier tasks needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def crc_mod(id_col: str, divisor: int):
    """``crc32(id as text) mod divisor``: the fold that the contracts hold out by."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


class Remembered(dict):
    """Bounded memo: after ``limit`` new keys the younger half becomes the older one."""

    def __init__(self, make: Callable[[Hashable], object], limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def known(self, key) -> bool:
        return key in self or key in self.old
