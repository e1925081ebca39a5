"""The shared folder for checkpoints, staged tables and test outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting a folder beside the warehouse tables, which executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tillroll/{label}-{uuid.uuid4().hex[:12]}"


def staged(
    df: DataFrame, label: str, codec: str | None = None, files: dict[str, str] | None = None
) -> DataFrame:
    """The rows written to the shared folder and read again: a short lineage that does not
    depend on the executors that made it. ``codec`` is Parquet's, by default the session's;
    ``files`` are other options of the writer."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**(files or {})).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(
    df: DataFrame,
    label: str,
    name: str = "place",
    codec: str | None = None,
    files: dict[str, str] | None = None,
) -> DataFrame:
    """The rows staged, with numbers 0, 1, 2 ... without holes in the column ``name``.

    The write fixes each row's place within its task; the rows of the tasks before it are summed
    over one row a task.
    """
    at = staged(df.withColumn(name, F.monotonically_increasing_id()), label, codec, files)
    task = F.shiftright(name, 33).alias("_task")
    before = F.sum("n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    sizes = at.groupBy(task).agg(F.count("*").alias("n")).select(
        "_task", F.coalesce(before, F.lit(0)).alias("_before")
    )
    within = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        at.withColumn("_task", F.shiftright(name, 33))
        .join(F.broadcast(sizes), "_task")
        .withColumn(name, F.col("_before") + within)
        .drop("_task", "_before")
    )
