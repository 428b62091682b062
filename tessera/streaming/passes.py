"""Import passes by place: the groups of a pass in the order of their ids, a slice [cursor, cursor + batch) a step.

The order is fixed when a pass begins and written once, so a group that lands later has its place in the next pass and moves
no other. A step merges its slice and then commits the cursor with the counts so far. Both are whole or not there: a step
that dies at any point is taken again from the same cursor, its merge gives the same rows, and its counts are counted once.
The step that reaches the end publishes.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import CommitLog
from ..operators.merge import Snapshots
from ..operators.publish import publish_next
from ..operators.ranged import FILE_ROWS
from ..scratch import numbered, scope
from .importer import SCHEMA, VERSIONS, catalogue, import_batch

#: Groups of a step; the group's id in a landed file's path.
BATCH, GROUP_OF = 1_000, r"(\d+)[^/]*$"
COUNTS = ("sets", "printings", "prices", "unmatched")


@dataclass
class Progress:
    """Where a pass is: `cursor` of `total` groups are taken in, with these counts; version once it is published."""

    run: int
    cursor: int = 0
    total: int = 0
    sets: int = 0
    printings: int = 0
    prices: int = 0
    unmatched: int = 0
    version: str | None = None

    @property
    def done(self) -> bool:
        return self.version is not None


class Passes:
    """The passes of one game over what has landed in a folder, with the catalogue and its packs under `root`."""

    def __init__(self, spark: SparkSession, game: str, landing: str, root: str, batch: int = BATCH, group_of: str = GROUP_OF, file_rows: int = FILE_ROWS):
        self.spark, self.game, self.landing, self.root = spark, game, landing, root.rstrip("/")
        self.batch, self.group_of, self.file_rows = batch, group_of, file_rows
        self.log = CommitLog(spark, f"{self.root}/progress")

    def progress(self) -> Progress | None:
        """The state after the newest step; None before the first."""
        newest = self.log.newest()
        return Progress(**self.log.read(newest)) if newest else None

    def listing(self, run: int) -> DataFrame:
        """place, gid, path: the groups of a pass, in order."""
        return self.spark.read.schema("place long, gid long, path string").parquet(f"{self.root}/passes/{run}")

    def begin(self) -> Progress:
        """A new pass over all that has landed by now, from its first group."""
        old = self.progress()
        run = (old.run if old else 0) + 1
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.landing)
        rows = found.select(F.nullif(F.regexp_extract("path", self.group_of, 1), F.lit("")).cast("long").alias("gid"), "path").where("gid IS NOT NULL")
        with scope(self.spark):
            rows = numbered(rows, ["gid", "path"], "place").select("place", "gid", "path")
            rows.write.mode("overwrite").parquet(f"{self.root}/passes/{run}")  # of a begin that died, too
        now = Progress(run, total=self.listing(run).count())
        self.log.write(self.log.newest() + 1, asdict(now))
        return now

    def step(self, version: str, now: datetime) -> Progress:
        """Takes in the next slice of the pass under way (of a new one, if none is), and publishes at its end."""
        at, state = self.log.newest(), self.progress()
        if state is None or state.done:
            state, at = self.begin(), at + 1
        end = min(state.total, state.cursor + self.batch)
        if end > state.cursor:
            slice_ = self.listing(state.run).where(F.col("place").between(state.cursor, end - 1))
            paths = [r["path"] for r in slice_.select("path").collect()]  # as many as a step's batch
            rows = self.spark.read.schema(SCHEMA).json(paths, multiLine=True)
            import_batch(self.game, rows, self.root, state.cursor, self.file_rows)
            counts = self.spark.read.schema(", ".join(f"{c} long" for c in COUNTS)).json(f"{self.root}/reports/batch={state.cursor}").first()
            state = Progress(state.run, end, state.total, *[getattr(state, c) + counts[c] for c in COUNTS])
        if state.cursor >= state.total:
            self.publish(version, now)
            state.version = version
        self.log.write(at + 1, asdict(state))  # of two workers on one step one fails here, having merged the same rows
        return state

    def publish(self, version: str, now: datetime) -> list[str]:
        store, tables = Snapshots(self.spark, f"{self.root}/versions"), catalogue(self.spark, self.root).read()
        if not tables:
            return []
        known = store.read()["versions"] if store.versions() else self.spark.createDataFrame([], VERSIONS)
        paths, versions = publish_next(tables, known, self.game, version, now, f"{self.root}/packs")
        store.write({"versions": versions})
        return paths

    def run(self, version: str, now: datetime) -> Progress:
        """Steps until a pass is done."""
        while not (state := self.step(version, now)).done:
            pass
        return state
