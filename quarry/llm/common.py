"""Helpers shared by the training-data operators: fresh column names, Arrow input, memory, states merged up a tree."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import materialise


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not got, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of an Arrow batch at most: what a worker holds doesn't depend on how long texts are, but for a single one.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to BATCH_BYTES, unless it is lower already.

    Spark reads the bound when a plan runs, and plans are returned before they do, so it stays lowered for the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def release() -> None:
    """Give memory that a batch needed back to the system: workers live on between stages, and allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string array's values, without decoding them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def pieces(values: Iterable, n: int) -> Iterator[list]:
    """Cut an iterable to lists of at most n."""
    part: list = []
    for v in values:
        part.append(v)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


#: A task's state, as a row of doubles, and how many of them one task of the merging tree takes.
STATE, FAN_IN = "task long, state array<double>", 16
STATES = pa.schema([("task", pa.int64()), ("state", pa.list_(pa.float64()))])


def state_of(state: np.ndarray) -> pa.RecordBatch:
    """This task's row of STATE."""
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([state.ravel()], pa.list_(pa.float64()))], schema=STATES)


def merged(states: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Merge states up a tree of FAN_IN branches, each node in a task; the driver gets the root alone."""
    states = materialise(states, "states")
    top = states.agg(F.max("task")).first()[0]
    if top is None:
        return None

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        out = None
        for s in group.column("state"):
            s = s.values.to_numpy(zero_copy_only=False)
            out = s if out is None else merge(out, s).ravel()
        return pa.Table.from_arrays([pa.array([group.column("node")[0].as_py()]), pa.array([out], pa.list_(pa.float64()))], schema=STATES)

    while top:
        top //= FAN_IN
        nodes = states.withColumn("node", F.floor(F.col("task") / FAN_IN))
        states = nodes.groupBy("node").applyInArrow(join, STATE)
    return np.array(states.first().state)
