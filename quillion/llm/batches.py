"""Arrow helpers shared by the operators that run in Python."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text (or of stored media) that one step of an operator holds decoded at once; a longer single value stands alone.
STEP_BYTES = 4 << 20
#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes; 10,000 long rows would otherwise be held several times over.

    A smaller bound that the session has already is left alone. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    value, unit = re.fullmatch(r"(\d+)\s*([kmg]?)i?b?", spark.conf.get(name).strip().lower()).groups()
    if int(value) << 10 * " kmg".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def steps(batch: pa.RecordBatch, column: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of ``batch`` in which ``column`` holds about ``limit`` bytes at most."""
    start = held = 0
    for i, value in enumerate(batch.column(column)):
        n = value.as_buffer().size if value.is_valid else 0
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def released(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run`` over a task's batches; at its end the worker, which Spark keeps for later tasks, gives back what it held.

    ``forget`` drops tables that are worth less than their memory beyond a task.
    """

    def of_task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                try:
                    ctypes.CDLL(None).malloc_trim(0)
                except AttributeError:  # another libc
                    pass

    return of_task


def array_steps(values: pa.Array) -> Iterator[pa.Array]:
    """Zero-copy slices of ``values`` of about STEP_BYTES at most."""
    for part in steps(pa.RecordBatch.from_arrays([values], names=["value"]), 0):
        yield part.column(0)


def keyed_map(df: DataFrame, keys: list[str], value: str, fn: Callable[[pa.Array], dict[str, pa.Array]], fields: list[tuple[str, str]], limit: int = STEP_BYTES) -> DataFrame:
    """Rows (keys, outputs of ``fn`` over ``value``); ``fn`` gets an Arrow array and gives equally long arrays by name.

    Keys keep name, type and nulls. Other columns of ``df``, whatever their
    names, are not read.
    """
    # Positional names inside, so that no key clashes with an output.
    inner = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{value}`").alias("value"))
    outputs = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(outputs)])
    names = [n for n, _ in fields]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, n_keys, limit):
                out = fn(part.column(n_keys))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keys], *[out[n] for n in names]], names=schema.names)

    bound_batches(df.sparkSession)
    done = inner.mapInArrow(released(run), schema)
    return done.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"o{i}").alias(n) for i, n in enumerate(names)])
