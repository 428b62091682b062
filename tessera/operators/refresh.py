"""The book-keeping of refreshes: import progress, published versions, runs, and what a client holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import BASE, merge_lww, set_where

COUNTERS = ("cursor", "total", "sets", "printings", "prices", "unmatched")


def reset_progress(progress: DataFrame, games: DataFrame, now: Column) -> DataFrame:
    """progress (game_id, run_id, COUNTERS, started_at, updated_at, done_at) with a new pass for games (game_id, run_id)."""
    new = games.select("game_id", "run_id", *[F.lit(0).cast("long").alias(c) for c in COUNTERS], now.alias("started_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("done_at"))
    return merge_lww(progress, new.select(*progress.columns).withColumn("seq", F.lit(0)), ["game_id"], "seq", [c for c in progress.columns if c != "game_id"])


def advance_progress(progress: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """progress after batches (game_id, next_cursor, size, and counts of the batch): counts add up, and a pass is done
    when its cursor has reached the size."""
    added = batches.groupBy("game_id").agg(F.max("next_cursor").alias("__cursor"), F.max("size").alias("__size"), *[F.sum(c).alias(f"__{c}") for c in COUNTERS[2:]])
    rows, hit = progress.join(added, "game_id", "left"), F.col("__cursor").isNotNull()
    new = {"cursor": F.col("__cursor"), "total": F.col("__size"), "updated_at": now, "done_at": F.when(F.col("__cursor") >= F.col("__size"), now)}
    new |= {c: F.col(c) + F.col(f"__{c}") for c in COUNTERS[2:]}
    return rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in progress.columns])


def record_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Published versions with new ones (and `seq`): a version published again keeps its time and index, not its count."""
    return merge_lww(versions, new, ["game_id", "version"], "seq", ["printings_count"])


def attach_index(versions: DataFrame, game: str, version: str, key: str) -> DataFrame:
    """The version's index key, once its pack has been stored."""
    here = (F.col("game_id") == game) & (F.col("version") == version)
    return versions.withColumn("index_pack_key", F.when(here, key).otherwise(F.col("index_pack_key")))


def fingerprints_done(printings: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return set_where(printings, ids, "id", fingerprinted_at=now)


def set_client_versions(held: DataFrame, new: DataFrame) -> DataFrame:
    """What a client holds of each game, all columns replaced by new rows (with `seq`)."""
    return merge_lww(held, new, ["game_id"], "seq", [c for c in held.columns if c != "game_id"])


def close_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """runs (id, started_at, finished_at, status, detail) with the end of those in `ended` (id and the last three)."""
    marked = runs.join(ended.select("id", F.struct("finished_at", "status", "detail").alias(BASE)), "id", "left")
    return marked.select(*[F.coalesce(f"{BASE}.{c}", c).alias(c) if c in ("finished_at", "status", "detail") else F.col(c) for c in runs.columns])
