"""The Raw, Bronze and Silver tables.

Raw is a table partitioned by ingest. Bronze lines lie in folders by generation (what one job
wrote), ingest and fate; lines deleted by hand stay as set-aside lines, so that no import brings
them back. Which pieces of which generations count, and which folders hold Silver, is named by
the current version (``versions.py``): imports, edits and Silver appear together, with the one
rename that commits them, and a reader that holds a version sees all layers as of it. Nothing is
changed in place, and a job that stops before its commit leaves nothing but unread folders.

What the lines of a generation add to Silver, per ingest, is summed once, by the first refresh
that counts it. Silver is added up from these sums, so a refresh reads none of the lines that an
earlier one has seen, and imports and edits that come before any refresh make no sums.

The catalog's names for Bronze and Silver are pointed at the version after each commit, one after
the other, for SQL; only ``scan_`` methods promise one version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import schemas
from tillroll.operators import silver
from tillroll.operators.edits import editable
from tillroll.operators.markets import as_doubles
from tillroll.operators.restock import with_buy_flag
from tillroll.session import staged
from tillroll.sources.versions import Conflict, Version, VersionLog

_LAYERS = ("raw", "bronze", "silver")
_SILVER = {
    "silver_product_stats": schemas.PRODUCT_STATS,
    "silver_market_stats": schemas.MARKET_STATS,
    "silver_monthly_spending": schemas.MONTHLY_SPENDING,
}
_PARTS: dict[str, Callable[..., DataFrame]] = {
    "silver_product_stats": silver.product_parts,
    "silver_market_stats": silver.market_parts,
    "silver_monthly_spending": silver.monthly_parts,
}
_PLACE = ("generation", "ingest_id", "rejected")


def scan_or_empty(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty frame if it does not exist; other errors surface."""
    if spark.catalog.tableExists(table):
        return spark.table(table)
    return spark.createDataFrame([], schema)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


@dataclass
class Layers:
    """Names and access of the layer tables under one root folder.

    ``prefix`` goes before the schema names raw, bronze and silver. With ``version`` all reads
    are as of it (see ``pinned``), else as of the newest.
    """

    spark: SparkSession
    root: str
    prefix: str = ""
    version: Version | None = None

    def name(self, layer: str, table: str) -> str:
        return f"{self.prefix}{layer}.{table}"

    @property
    def log(self) -> VersionLog:
        return VersionLog(self.spark, f"{self.root}/versions")

    def now(self) -> Version:
        return self.version or self.log.latest()

    def pinned(self) -> Layers:
        """The tables as they are now, whatever is committed later."""
        return replace(self, version=self.now())

    def create(self) -> None:
        """Create schemas, tables and views that are missing; take over tables of old forms."""
        sql = self.spark.sql
        for layer in _LAYERS:
            sql(f"CREATE SCHEMA IF NOT EXISTS {self.prefix}{layer} LOCATION '{self.root}/{layer}'")
        sql(
            f"CREATE TABLE IF NOT EXISTS {self.name('raw', 'raw_purchases')} ({_ddl(schemas.RAW)}, "
            f"{_ddl(schemas.BY_INGEST)}) USING parquet PARTITIONED BY (ingest_id)"
        )
        for table, schema in _SILVER.items():
            sql(
                f"CREATE TABLE IF NOT EXISTS {self.name('silver', table)} ({_ddl(schema)}) "
                f"USING parquet LOCATION '{self._silver_folder(table, 'silver_empty')}'"
            )
        self.evolve()
        self._point_names(self.log.latest())

    # --- Reading -------------------------------------------------------------------

    def scan_raw(self) -> DataFrame:
        whole = T.StructType([*schemas.RAW.fields, *schemas.BY_INGEST.fields])
        return scan_or_empty(self.spark, self.name("raw", "raw_purchases"), whole)

    def raw_ingests(self) -> DataFrame:
        """(ingest_id) of all of Raw, from the catalog's partition list."""
        parts = self.spark.sql(f"SHOW PARTITIONS {self.name('raw', 'raw_purchases')}")
        return parts.select(F.substring_index("partition", "ingest_id=", -1).alias("ingest_id"))

    def scan_pieces(self) -> DataFrame:
        """Which pieces of Bronze count, one row for each generation of an ingest."""
        folder = self.now().pieces
        if folder is None:
            return self.spark.createDataFrame([], schemas.PIECES)
        return self.spark.read.schema(schemas.PIECES).parquet(self._pieces_folder(folder))

    def scan_lines(self, pieces: DataFrame | None = None) -> DataFrame:
        """Every line taken in, fit for use or set aside; of all pieces or of some.

        Only the folders of these pieces are listed and read; their names come to the driver,
        as the list of a table's files does.
        """
        pieces = self.scan_pieces() if pieces is None else pieces
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folders = [
            f"{self._lines_folder(r['generation'])}/ingest_id={escaped.escapePathName(r['ingest_id'])}"
            for r in pieces.where("lines > 0").select("generation", "ingest_id").collect()
        ]
        return self._read_lines(folders).drop("generation")

    def _read_lines(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schemas.PLACED_LINES)
        reader = self.spark.read.schema(schemas.PLACED_LINES)
        return reader.option("basePath", f"{self.root}/bronze/lines").parquet(*folders)

    def scan_deleted(self) -> DataFrame:
        """(raw_id, deleted_at, ingest_id) of lines deleted by hand."""
        gone = self.scan_lines(self.scan_pieces().where("deleted > 0")).where(
            F.col("rejected") & (F.col("reject_reason") == schemas.DELETED_BY_HAND)
        )
        return gone.select("raw_id", F.col("processed_at").alias("deleted_at"), "ingest_id")

    def scan_bronze_exact(self) -> DataFrame:
        """All Bronze columns with their decimals."""
        lines = self.scan_lines().where(~F.col("rejected"))
        return lines.select(*schemas.BRONZE.fieldNames(), "ingest_id")

    def scan_bronze(self) -> DataFrame:
        """The columns analyses need, price as double, plus the id that settles ties."""
        lines = self.scan_bronze_exact().select(
            "id", "purchase_date", "product_id", "product_price", "market_id"
        )
        return as_doubles(lines, "product_price")

    def scan_bronze_editable(self) -> DataFrame:
        lines = editable(self.scan_bronze_exact())
        return lines.orderBy(F.desc("purchase_date"), F.desc("id"))

    def scan_silver(self, table: str) -> DataFrame:
        name = self.now().silver
        if name is None:
            return self.spark.createDataFrame([], _SILVER[table])
        return self.spark.read.schema(_SILVER[table]).parquet(self._silver_folder(table, name))

    def scan_product_stats(self) -> DataFrame:
        return with_buy_flag(self.scan_silver("silver_product_stats"))

    def scan_market_stats(self) -> DataFrame:
        return as_doubles(self.scan_silver("silver_market_stats"), "total_spent", "avg_ticket")

    def scan_monthly_spending(self) -> DataFrame:
        return as_doubles(self.scan_silver("silver_monthly_spending"), "total_spent", "avg_price")

    # --- Writing -------------------------------------------------------------------

    def _lines_folder(self, generation: str) -> str:
        return f"{self.root}/bronze/lines/generation={generation}"

    def _pieces_folder(self, name: str) -> str:
        return f"{self.root}/bronze/pieces/{name}"

    def _silver_folder(self, table: str, version: str) -> str:
        return f"{self.root}/silver/{table}/{version}"

    def _parts_folder(self, table: str, generation: str = "") -> str:
        return f"{self.root}/silver/parts/{table}" + (f"/generation={generation}" if generation else "")

    def append_raw(self, df: DataFrame, ingest: str) -> None:
        """Add an ingest. Its folder is the output folder of the write, so that writers who
        append at the same time have no temporary folder in common."""
        folder = f"{self.root}/raw/raw_purchases/ingest_id={ingest}"
        df.select(*schemas.RAW.fieldNames()).write.options(**schemas.FILES).parquet(folder)
        name = self.name("raw", "raw_purchases")
        self.spark.sql(
            f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (ingest_id = '{_quoted(ingest)}') "
            f"LOCATION '{_quoted(folder)}'"
        )
        self.spark.catalog.refreshTable(name)

    def reserve_ids(self, count: int) -> int:
        """The first of so many line ids, which no other writer gets."""
        while True:
            now = self.log.latest()
            if self.log.put(replace(now, number=now.number + 1, next_id=now.next_id + count)):
                return now.next_id

    def write_generation(
        self, lines: DataFrame, whole: DataFrame | bool, source: str | None = None
    ) -> DataFrame:
        """Write lines (with ingest_id and rejected) to a folder of their own; their pieces.
        ``whole`` says whether the ingests are done with them, or for which (ingest_id, whole):
        those get a piece even without a line."""
        generation = f"g-{uuid.uuid4().hex[:16]}"
        folder = self._lines_folder(generation)
        columns = [c for c in schemas.PLACED_LINES.fieldNames() if c != "generation"]
        placed = lines.select(*columns).write.partitionBy("ingest_id", "rejected")
        placed.options(**schemas.FILES).parquet(folder)
        written = self._read_lines([folder])
        gone = F.col("reject_reason") == schemas.DELETED_BY_HAND
        found = written.groupBy("ingest_id").agg(
            F.count("*").alias("lines"), F.count_if(gone).alias("deleted")
        )
        if isinstance(whole, bool):
            found = found.withColumn("whole", F.lit(whole))
        else:
            found = whole.join(found, "ingest_id", "left").fillna(0, ["lines", "deleted"])
        named = {"generation": F.lit(generation), "source": F.lit(source).cast("string")}
        return staged(schemas.conform(found.withColumns(named), schemas.PIECES), "pieces")

    def commit(
        self,
        base: Version,
        pieces: DataFrame | None = None,
        replaced: DataFrame | None = None,
        *,
        refresh: bool = False,
        as_of: date | str | None = None,
        next_id: int = 1,
        streams: dict[str, int] | None = None,
        edit: str | None = None,
        counts: dict[str, int] | None = None,
    ) -> Version:
        """Make new pieces count, in place of all earlier ones of the ``replaced`` ingests
        (ingest_id), and with ``refresh`` a Silver that counts them in.

        ``base`` is the version the pieces were made from. Of commits since then, those that
        left the ingests of these pieces alone do not matter; others are a Conflict.
        """
        while True:
            now = replace(self, version=self.log.latest())
            new = replace(
                now.version,
                number=now.version.number + 1,
                next_id=max(now.version.next_id, next_id),
                streams=now.version.streams | (streams or {}),
                edit=edit,
                counts=counts,
            )
            if pieces is not None:
                if now.version.pieces != base.pieces:
                    self._check_unchanged(replace(self, version=base), now, pieces)
                kept = now.scan_pieces()
                if replaced is not None:
                    kept = kept.join(replaced, "ingest_id", "left_anti")
                name = f"p-{uuid.uuid4().hex[:16]}"
                # as many rows as ingests have generations
                kept.unionByName(pieces).coalesce(1).write.parquet(self._pieces_folder(name))
                new = replace(new, pieces=name)
            if refresh:
                new = replace(new, silver=replace(self, version=new).write_silver(as_of))
            if self.log.put(new):
                self._point_names(self.log.latest())
                return new

    @staticmethod
    def _check_unchanged(before: Layers, now: Layers, pieces: DataFrame) -> None:
        ingests = pieces.select("ingest_id").distinct()
        then, there = (
            x.scan_pieces().join(ingests, "ingest_id", "left_semi").select("ingest_id", "generation")
            for x in (before, now)
        )
        if not then.exceptAll(there).isEmpty() or not there.exceptAll(then).isEmpty():
            raise Conflict("lines of the same ingests were changed meanwhile")

    def scan_parts(self, table: str) -> DataFrame:
        """What the pieces that count add to a Silver table; summed here for generations that no
        refresh has seen. Generations of which nothing counts any more are not read."""
        pieces = self.scan_pieces().where("lines > deleted")
        generations = [r[0] for r in pieces.select("generation").distinct().collect()]
        for generation in generations:
            self._sum_up(table, generation)
        kind = _PARTS[table](
            self.spark.createDataFrame([], schemas.PLACED_LINES), "generation", "ingest_id"
        ).schema
        if not generations:
            return self.spark.createDataFrame([], kind)
        reader = self.spark.read.schema(kind).option("basePath", self._parts_folder(table))
        parts = reader.parquet(*[self._parts_folder(table, g) for g in generations])
        return parts.join(pieces, ["generation", "ingest_id"], "left_semi")

    def _sum_up(self, table: str, generation: str) -> None:
        """Write what a generation's lines add to a Silver table, unless that is there. The sums
        appear whole, by a rename; of two refreshes that make them the second's stay unread."""
        folder = self._parts_folder(table, generation)
        if self.log.exists(folder):
            return
        made = f"{self._parts_folder(table)}/_{uuid.uuid4().hex}"
        usable = self._read_lines([self._lines_folder(generation)]).where(~F.col("rejected"))
        parts = _PARTS[table](usable, "ingest_id")
        parts.write.parquet(made, compression=schemas.CODEC)
        self.log.place(made, folder)

    def write_silver(self, as_of: date | str | None = None) -> str:
        """Add up Silver of the version's pieces in new folders; their name."""
        made = {
            "silver_product_stats": lambda parts: silver.products_of_parts(parts, as_of),
            "silver_market_stats": silver.markets_of_parts,
            "silver_monthly_spending": silver.months_of_parts,
        }
        name = f"v-{uuid.uuid4().hex[:12]}"
        for table, schema in _SILVER.items():
            frame = made[table](self.scan_parts(table))
            schemas.conform(frame, schema).write.parquet(self._silver_folder(table, name))
        return name

    def _point_names(self, version: Version) -> None:
        """Point the catalog's names at a version: a view each for Bronze, a folder for Silver."""
        sql = self.spark.sql
        at = replace(self, version=version)
        if version.pieces is None or at.scan_pieces().where("lines > 0").isEmpty():
            columns = ", ".join(
                f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schemas.PLACED_LINES
            )
            lines = f"(SELECT {columns} WHERE false)"
        else:
            lines = (
                f"(SELECT l.* FROM parquet.`{self.root}/bronze/lines` l LEFT SEMI JOIN "
                f"parquet.`{self._pieces_folder(version.pieces)}` USING (generation, ingest_id))"
            )
        fate = "CAST(rejected AS BOOLEAN)"
        sql(
            f"CREATE OR REPLACE VIEW {self.name('bronze', 'bronze_purchases')} AS SELECT "
            f"{', '.join(schemas.BRONZE.fieldNames())}, ingest_id FROM {lines} WHERE NOT {fate}"
        )
        sql(
            f"CREATE OR REPLACE VIEW {self.name('bronze', 'bronze_rejects')} AS SELECT "
            f"raw_id, reject_reason AS reason, processed_at, ingest_id FROM {lines} WHERE {fate} "
            f"AND reject_reason <> '{schemas.DELETED_BY_HAND}'"
        )
        for table in _SILVER if version.silver else ():
            name = self.name("silver", table)
            place = _quoted(self._silver_folder(table, version.silver))
            sql(f"ALTER TABLE {name} SET LOCATION '{place}'")
            self.spark.catalog.refreshTable(name)

    def evolve(self) -> dict[str, list[str]]:
        """Add the later columns where missing; the added ones by table.

        Raw gets them as null. A Bronze of the old form, one table with its lines by ingest and
        fate and another of deleted ids, is copied once, amounts backfilled, and counts from the
        commit on: until then the old table is as it was, and a run that stops is run again.
        """
        added = {}
        name = self.name("raw", "raw_purchases")
        missing = schemas.missing_columns(self.spark.table(name))
        if missing:
            kinds = ", ".join(f"{c} {schemas.RAW[c].dataType.simpleString()}" for c in missing)
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({kinds})")
            added["raw.raw_purchases"] = missing
        old, base = self.name("bronze", "bronze_lines"), self.log.latest()
        if base.pieces is None and self.spark.catalog.tableExists(old):
            table = self.spark.table(old)
            missing = schemas.missing_columns(table)
            lines = schemas.evolve_purchases(table, backfill=True)
            deleted = self.name("bronze", "bronze_deleted")
            if self.spark.catalog.tableExists(deleted):
                ids = self.spark.table(deleted).select("ingest_id", "raw_id", "deleted_at").distinct()
                lines = lines.join(
                    ids.where(F.col("raw_id") != 0), ["ingest_id", "raw_id"], "left_anti"
                ).unionByName(tombstones(ids.withColumn("id", F.col("raw_id")), "deleted_at"), True)
            top = lines.agg(F.max(F.greatest("id", "raw_id"))).first()[0] or 0
            next_id = max(base.next_id, top + 1)
            self.commit(
                base, self.write_generation(lines, False), refresh=True, next_id=next_id
            )
            added["bronze.bronze_lines"] = missing
        return added


def tombstones(lines: DataFrame, stamp: str) -> DataFrame:
    """Set-aside lines that keep the ids (id, raw_id, ingest_id) of lines deleted by hand."""
    marked = lines.withColumns(
        {
            "processed_at": F.col(stamp),
            "reject_reason": F.lit(schemas.DELETED_BY_HAND),
            "rejected": F.lit(True),
        }
    ).select("id", "raw_id", "processed_at", "reject_reason", "ingest_id", "rejected")
    whole = T.StructType([f for f in schemas.PLACED_LINES if f.name != "generation"])
    return schemas.conform(marked, whole)
