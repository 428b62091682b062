"""Resumable import: each micro-batch takes some landed groups into the catalogue, the checkpoint is the cursor.

A landed file is one group: {"group": ..., "products": [...], "prices": [...]}. The four tables change together, in one
commit, so a reader never sees new printings with old prices. Tables are files of key ranges: a batch rewrites those that
its keys fall into, not the catalogue. A batch that fails is taken again: its merge is
idempotent, and its counts and quarantine replace those of its own number. Once all is taken in, the catalogue is
published and its version recorded.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import UPDATES, import_feed
from ..operators.merge import Snapshots
from ..operators.publish import publish_next
from ..operators.ranged import FILE_ROWS, RangedTables, Touched
from ..sources.feed import GROUP, PRICE, PRODUCT, _typed

#: Files of one micro-batch.
GROUPS_PER_BATCH = 1_000
REPORT = "sets long, printings long, unmatched long, prices long"
VERSIONS = "game_id string, version string, printings_count long, index_pack_key string, created_at timestamp"


def landed(group: str, product: str, price: str) -> str:
    inner = [f"struct<{','.join(_typed(x))}>" for x in (group, product, price)]
    return f"`group` {inner[0]}, products array<{inner[1]}>, prices array<{inner[2]}>"


SCHEMA = landed(GROUP, PRODUCT, PRICE)


def catalogue(spark: SparkSession, root: str, file_rows: int = FILE_ROWS) -> RangedTables:
    """The catalogue's stored tables under an import's folder."""
    return RangedTables(spark, f"{root}/catalogue", {name: key for name, (key, _) in UPDATES.items()}, file_rows)


def import_batch(game: str, rows: DataFrame, root: str, batch_id: int = 0, file_rows: int = FILE_ROWS) -> dict[str, Touched]:
    """Merges one batch of landed groups into the catalogue under `root`, with its counts and quarantine; the files that
    each table's merge touched."""
    spark = rows.sparkSession
    groups = rows.select("group.*")
    gid = F.col("group.groupId").alias("groupId")
    products = rows.select(gid, F.posexplode("products").alias("pos", "x")).select("pos", "x.*")
    prices = rows.select(gid, F.posexplode("prices").alias("pos", "x")).select("groupId", "pos", "x.*")
    store = catalogue(spark, root, file_rows)
    new = import_feed(game, groups, products, prices, F.current_timestamp(), store.read().get("printings"))
    changes = {name: getattr(new, name) for name in UPDATES} | {"prices": new.prices.where("printing_id IS NOT NULL")}
    touched = store.merge(changes, "seq", {name: update for name, (_, update) in UPDATES.items()})
    new.unmatched.write.mode("overwrite").json(f"{root}/unmatched/batch={batch_id}")
    new.report().write.mode("overwrite").json(f"{root}/reports/batch={batch_id}")
    return touched


def run_import(spark: SparkSession, game: str, landing: str, root: str, checkpoint: str, per_batch: int = GROUPS_PER_BATCH) -> None:
    """Takes all landed files that no earlier run has taken."""
    stream = spark.readStream.schema(SCHEMA).option("multiLine", "true").option("maxFilesPerTrigger", per_batch).json(landing)
    query = stream.writeStream.foreachBatch(lambda rows, n: import_batch(game, rows, root, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def totals(spark: SparkSession, root: str) -> DataFrame:
    """One row: the sums of all batches' counts."""
    return spark.read.schema(f"{REPORT}, batch long").json(f"{root}/reports").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sets", "printings", "prices", "unmatched")])


def run_refresh(spark: SparkSession, game: str, landing: str, root: str, checkpoint: str, version: str, now: datetime, per_batch: int = GROUPS_PER_BATCH) -> list[str]:
    """Imports what has landed, publishes the game's packs under root/packs once, and records the version; the paths."""
    run_import(spark, game, landing, root, checkpoint, per_batch)
    store = Snapshots(spark, f"{root}/versions")
    known = store.read()["versions"] if store.versions() else spark.createDataFrame([], VERSIONS)
    paths, versions = publish_next(catalogue(spark, root).read(), known, game, version, now, f"{root}/packs")
    store.write({"versions": versions})
    return paths
