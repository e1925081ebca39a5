"""Jobs that move purchase lines through the layer tables."""

from __future__ import annotations

import uuid
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import cleaning, edits
from tillroll.schemas import CODEC, FILES
from tillroll.session import numbered, staged
from tillroll.sources.tables import Layers, tombstones
from tillroll.sources.versions import Conflict

ATTEMPTS = 5
# So many ingests may share the tasks of a rewrite, each with a file in each of them.
FEW_INGESTS = 16


def ingest_to_raw(layers: Layers, df: DataFrame, source_type: str) -> str:
    """Append lines of any source to Raw as text; the name of the new ingest.

    Lines are staged and counted, and get ids without holes from a block that the version log
    reserves, so that several writers can work at once. Only an ingest that stops after that
    leaves its block unused. The ids are fixed by this write and only read from then on.
    """
    texts = cleaning.stringify_purchases(df, source_type)
    lines = numbered(texts, "ingest", "id", CODEC, FILES)
    first = layers.reserve_ids(lines.count())
    ingest = f"{first:016d}-{uuid.uuid4().hex[:12]}"
    layers.append_raw(lines.withColumn("id", F.col("id") + F.lit(first)), ingest)
    return ingest


def pending_ingests(layers: Layers) -> DataFrame:
    """(ingest_id, partly) of ingests of Raw that Bronze is not done with; True where a stream
    has brought some of their lines.

    Names of partitions are compared with the version's pieces; no line is read or counted.
    """
    done = layers.scan_pieces().groupBy("ingest_id").agg(F.bool_or("whole").alias("whole"))
    state = layers.raw_ingests().join(done, "ingest_id", "left")
    return state.where("whole IS NULL OR NOT whole").select(
        "ingest_id", F.col("whole").isNotNull().alias("partly")
    )


def fated(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn("rejected", F.col("reject_reason").isNotNull())


def _taken_in(
    layers: Layers, strict: bool, resurrect: bool
) -> tuple[DataFrame | None, DataFrame | None]:
    """Write what a version lacks; the new pieces, and the ingests whose earlier ones they
    replace. Raw is read in the partitions of these ingests only."""
    names = pending_ingests(layers).collect()
    back = []
    if resurrect:
        back = [r[0] for r in layers.scan_pieces().where("deleted > 0").select("ingest_id").distinct().collect()]
    pieces, stamp = None, datetime.now(tz=UTC)

    def cleaned(raw: DataFrame) -> DataFrame:
        return fated(cleaning.clean_purchases(raw, processed_at=stamp, strict=strict))

    def raw_of(ingests: list[str]) -> DataFrame:
        return layers.scan_raw().where(F.col("ingest_id").isin(ingests))

    if names:
        raw = raw_of([r["ingest_id"] for r in names])
        begun = [r["ingest_id"] for r in names if r["partly"]]
        if begun:
            before = layers.scan_pieces().where(F.col("ingest_id").isin(begun))
            raw = cleaning.unprocessed_raw(raw, layers.scan_lines(before))
        done = layers.spark.createDataFrame(
            [(r["ingest_id"], True) for r in names], "ingest_id string, whole boolean"
        )
        pieces = layers.write_generation(cleaned(raw), done)
    if not back:
        return pieces, None
    of = layers.scan_pieces().where(F.col("ingest_id").isin(back))
    ids = layers.scan_deleted().where(F.col("ingest_id").isin(back)).select("ingest_id", "raw_id")
    raw = raw_of(back).withColumnRenamed("id", "raw_id").join(ids, ["ingest_id", "raw_id"], "left_semi")
    kept = layers.scan_lines(of).where(F.coalesce("reject_reason", F.lit("")) != "deleted")
    again = kept.unionByName(cleaned(raw.withColumnRenamed("raw_id", "id")))
    states = of.groupBy("ingest_id").agg(F.bool_or("whole").alias("whole"))
    rewritten = layers.write_generation(again.hint("rebalance", "ingest_id"), states)
    replaced = rewritten.select("ingest_id")
    return (rewritten if pieces is None else pieces.unionByName(rewritten)), replaced


def _import(
    layers: Layers, strict: bool, resurrect: bool, refresh: bool, as_of: date | str | None
) -> int:
    for attempt in range(ATTEMPTS):
        base = layers.pinned()
        pieces, replaced = _taken_in(base, strict, resurrect)
        if pieces is None and not refresh:
            return 0
        try:
            layers.commit(base.now(), pieces, replaced, refresh=refresh, as_of=as_of)
        except Conflict:  # another import was first: see what is left to do
            if attempt + 1 == ATTEMPTS:
                raise
            continue
        if pieces is None:
            return 0
        new = base.scan_lines(pieces).where(~F.col("rejected")).count()
        if replaced is None:
            return new
        old = base.scan_pieces().join(replaced, "ingest_id", "left_semi")
        return new - base.scan_lines(old).where(~F.col("rejected")).count()
    return 0


def raw_to_bronze(layers: Layers, *, strict: bool = False, resurrect: bool = False) -> int:
    """Take in every raw line that is not in Bronze; the number of lines added.

    Ingests that were never touched need no join; only those that a stream has begun are
    compared by id. A stop before the commit leaves Bronze as it was. ``resurrect`` brings
    lines back that were deleted by hand.
    """
    return _import(layers, strict, resurrect, False, None)


def refresh_silver(layers: Layers, as_of: date | str | None = None) -> None:
    """Add the three aggregates up from what the pieces of Bronze add to them."""
    layers.commit(layers.now(), refresh=True, as_of=as_of)


def refresh_layers(layers: Layers, as_of: date | str | None = None) -> int:
    """Raw to Bronze to Silver, in one commit; the number of new Bronze lines."""
    return _import(layers, False, False, True, as_of)


def import_purchases(
    layers: Layers, df: DataFrame, source_type: str, as_of: date | str | None = None
) -> int:
    ingest_to_raw(layers, df, source_type)
    return refresh_layers(layers, as_of)


def migrate_legacy(layers: Layers, legacy_table: str) -> int:
    """Copy a legacy four-column table to Raw once; the number of lines copied."""
    spark = layers.spark
    if not spark.catalog.tableExists(legacy_table) or not layers.scan_raw().isEmpty():
        return 0
    legacy = spark.table(legacy_table)
    if legacy.isEmpty():
        return 0
    columns = ("purchase_date", "product_id", "product_price", "market_id")
    ingest_to_raw(layers, legacy.select(*columns), "migration")
    return layers.scan_raw().count()


def apply_edits(
    layers: Layers,
    original: DataFrame,
    edited: DataFrame,
    as_of: date | str | None = None,
    *,
    edit_id: str | None = None,
) -> dict[str, int]:
    """Put the changes between two editable sets into Bronze and Silver, in one commit.

    The sets may be all of Bronze or any part of it; a line is deleted if it is in the
    original and not in the edited set. Only ingests with a changed line are rewritten.

    Until the commit readers see nothing of an edit, and one that stops leaves nothing. Each call
    counts, also if it adds the same lines as one before; a caller who may repeat a call names it
    by ``edit_id``, and the second time only the counts are given back. A Conflict is raised if
    a line to update is not there any more, or if another commit rewrote the same ingests; such
    an edit can be made again.
    """
    done = layers.log.of_edit(edit_id) if edit_id else None
    if done:
        return done.counts
    edit_id = edit_id or uuid.uuid4().hex
    stamp = datetime.now(tz=UTC)
    base = layers.pinned()
    changed = edits.diff_purchases(original, edited).where("op != 'unchanged'")
    diff = staged(changed, "diff", CODEC)
    found = {r["op"]: r["n"] for r in edits.change_counts(diff).collect()}
    if found.get("unknown"):
        raise ValueError(f"{found['unknown']} edited lines have an id that is not in Bronze")
    counts = {op: found.get(op, 0) for op in ("inserted", "updated", "deleted")}
    if not any(counts.values()):
        return counts

    changes = edits.cleaned_changes(diff, stamp)
    bronze = base.scan_bronze_exact()
    changed = changes.where("op != 'inserted'").select("id", "op")
    located = bronze.join(changed, "id").select("id", "op", "raw_id", "ingest_id")
    located = staged(located, "located", CODEC)
    if located.where("op = 'updated'").count() < counts["updated"]:
        raise Conflict("lines to update are not in Bronze any more")
    touched = located.select("ingest_id").distinct()
    of = base.scan_pieces().join(touched, "ingest_id", "left_semi")
    # Files of a version stay as they are: they can be read once more for each use.
    before = base.scan_lines(of)
    usable = before.where(~F.col("rejected"))
    gone = located.where((F.col("op") == "deleted") & (F.col("raw_id") != cleaning.MANUAL_RAW_ID))
    lines = (
        edits.merge_changes(usable, changes)
        .unionByName(before.where("rejected"))
        .unionByName(tombstones(gone.withColumn("at", F.lit(stamp).cast("timestamp")), "at"))
    )
    states = of.groupBy("ingest_id").agg(F.bool_or("whole").alias("whole"))
    if counts["inserted"]:
        first = layers.reserve_ids(counts["inserted"])
        manual = f"manual-{uuid.uuid5(uuid.NAMESPACE_OID, edit_id).hex}"
        added = numbered(edits.inserted_lines(changes), "added", "id", CODEC).withColumns(
            {
                "id": F.col("id") + F.lit(first),
                "ingest_id": F.lit(manual),
                "reject_reason": F.lit(None).cast("string"),
                "rejected": F.lit(False),
            }
        )
        lines = lines.unionByName(added)
        own = layers.spark.createDataFrame([(manual, True)], states.schema)
        states = states.unionByName(own)
    # Of many ingests each task would write a small file each: their lines are brought together
    # first, a large ingest split over tasks. Few are written as the join leaves them.
    if touched.limit(FEW_INGESTS + 1).count() > FEW_INGESTS:
        lines = lines.hint("rebalance", "ingest_id")
    pieces = layers.write_generation(lines, states)
    layers.commit(
        base.now(),
        pieces,
        pieces.select("ingest_id"),
        refresh=True,
        as_of=as_of,
        edit=edit_id,
        counts=counts,
    )
    return counts
