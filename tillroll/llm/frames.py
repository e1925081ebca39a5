"""Columns of input frames that an operator adds its own to."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OTHERS = "_others"
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """At most ROWS_PER_BATCH documents go to a task's Python at once, from now on: the session's
    default of ten times that is meant for narrower rows than whole texts."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(setting, str(ROWS_PER_BATCH))


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> Iterator[None]:
    """At most so many rows go to a task's Python at once in what is run meanwhile."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def give_back() -> None:
    """What Arrow and the allocator hold free goes back to the system. Python workers live on
    from stage to stage, more of them than there are cores, and would keep what their largest
    task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that leaves no free memory in its worker."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names, in any case: the operator's own replace them."""
    added = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added])


def set_aside(df: DataFrame, *kept: str) -> DataFrame:
    """The kept columns, and all others in one struct column that clashes with nothing."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in kept]
    return df.select(*kept, F.struct(F.lit(0).alias("-"), *others).alias(OTHERS))


def brought_back(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns that ``set_aside`` took, in their order; ``own`` ones as they now are."""
    return df.select(*[F.col(c) if c in own else F.col(OTHERS)[c].alias(c) for c in columns])
