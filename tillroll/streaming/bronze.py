"""Raw to Bronze as a checkpointed stream over new raw files."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import cleaning
from tillroll.plans.imports import ATTEMPTS, fated
from tillroll.session import shared_folder
from tillroll.sources.tables import Layers
from tillroll.sources.versions import Conflict


def take_in_batch(
    layers: Layers, batch: DataFrame, number: int, query_id: str, strict: bool = False
) -> None:
    """Put the new lines of a micro-batch into Bronze, once.

    The version's record names the last batch of each stream, in the commit that brought its
    lines: a batch that is run again is known by its number and not read. What the stream itself
    has brought earlier never comes again; only ingests that an import, an edit or another
    stream has touched are looked at, whole ones by name and begun ones by id.
    """
    for attempt in range(ATTEMPTS):
        base = layers.pinned()
        if number <= base.now().streams.get(query_id, -1):
            return
        pieces = base.scan_pieces()
        # Names of ingests only, which the driver lists as well: a shuffle by them would take a
        # whole ingest to one task.
        whole = F.broadcast(pieces.where("whole").select("ingest_id").distinct())
        fresh = batch.join(whole, "ingest_id", "left_anti")
        others = pieces.where(
            ~F.col("whole") & ~F.col("source").eqNullSafe(F.lit(query_id))
        ).join(whole, "ingest_id", "left_anti")
        if not others.isEmpty():
            fresh = cleaning.unprocessed_raw(fresh, base.scan_lines(others))
        cleaned = cleaning.clean_purchases(fresh, processed_at=datetime.now(tz=UTC), strict=strict)
        written = layers.write_generation(fated(cleaned), False, query_id)
        try:
            layers.commit(base.now(), written, streams={query_id: number})
            return
        except Conflict:
            if attempt + 1 == ATTEMPTS:
                raise


def raw_to_bronze_stream(
    layers: Layers,
    name: str,
    *,
    checkpoint: str | None = None,
    max_files: int | None = None,
    strict: bool = False,
) -> None:
    """Take in all raw files not yet seen under this stream name, then stop.

    The checkpoint skips files already read, and the version log batches already committed.
    """
    checkpoint = checkpoint or f"{shared_folder(layers.spark)}/tillroll/streams/{name}"

    def write(batch: DataFrame, number: int) -> None:
        # A micro-batch has a session of its own; its tables are used through that one.
        own = replace(layers, spark=batch.sparkSession)
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        take_in_batch(own, batch, number, query_id, strict)

    reader = layers.spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        reader.table(layers.name("raw", "raw_purchases"))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
