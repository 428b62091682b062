"""Keyed tables as files of disjoint key ranges, so that a merge rewrites only the files whose ranges its keys fall into.

A commit lists the files of each table with their least and greatest keys and numbers of rows. A key belongs to the last
file whose least key is not above it (to the first file, if there is none), whether the file has it or not: so an insert has
one place as an update has. A merge finds the files of its keys, merges those files alone, writes new ones in their
place, and commits the list of kept and new files in one step; readers see all tables of one version.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import remove, scope, written
from .commits import CommitLog
from .merge import merge_lww

#: Rows of a file; it is cut once it has twice as many.
FILE_ROWS = 1_000_000
OWNER = "__owner"


@dataclass
class Touched:
    """How many files of a table a merge kept, replaced and wrote."""

    kept: int
    replaced: int
    written: int


def owner(keys: list[list], *columns: Column) -> Column:
    """The place among files with these least keys, in order, of the one that a row's key belongs to."""

    @F.pandas_udf("int")
    def find(*parts: pd.Series) -> pd.Series:
        least = [tuple(k) for k in keys]
        return pd.Series([max(0, bisect_right(least, k) - 1) for k in zip(*parts, strict=True)], dtype="int32")

    return find(*columns)


class RangedTables:
    """Versions of several keyed tables under one folder. keys: the key columns of each table (strings or whole numbers, never
    null)."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, Sequence[str]], file_rows: int = FILE_ROWS):
        self.spark, self.root, self.keys, self.file_rows = spark, root.rstrip("/"), {n: list(k) for n, k in keys.items()}, file_rows
        self.log = CommitLog(spark, f"{self.root}/commits")

    def versions(self) -> list[int]:
        return self.log.numbers()

    def commit(self, version: int | None = None) -> dict:
        version = version or self.log.newest()
        return self.log.read(version) if version else {}

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the newest unless one is named; none where there is no version."""
        return {name: self._rows(table, table["files"]) for name, table in self.commit(version).items()}

    def _rows(self, table: dict, files: list[dict]) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f['path']}" for f in files])

    def merge(self, changes: dict[str, DataFrame], order: str, update: dict[str, Sequence[str]]) -> dict[str, Touched]:
        """A new version with changes (a table's columns and `order`) merged as merge.merge_lww does. Fails where another
        writer commits first; what it wrote goes."""
        base = self.log.newest()
        old = self.commit(base)
        folder, out, new = f"v{base + 1}-{uuid.uuid4().hex}", {}, dict(old)
        try:
            for name, rows in changes.items():
                with scope(self.spark):
                    new[name], out[name] = self._merged(name, old.get(name), rows, order, update[name], f"{folder}/{name}")
            self.log.write(base + 1, new)
        except BaseException:
            if not self.log.made(base + 1, new):
                remove(self.spark, f"{self.root}/{folder}")
            raise
        return out

    def _merged(self, name: str, table: dict | None, changes: DataFrame, order: str, update: Sequence[str], folder: str) -> tuple[dict, Touched]:
        key = self.keys[name]
        table = table or {"schema": changes.drop(order).schema.jsonValue(), "files": []}
        files = table["files"]
        place = owner([f["least"] for f in files], *[F.col(c) for c in key])
        changes = written(changes.withColumn(OWNER, place), "changes")
        rows_of = {r[OWNER]: r["n"] for r in changes.groupBy(OWNER).agg(F.count("*").alias("n")).collect()}  # as many as files at most
        if not rows_of:
            return table, Touched(len(files), 0, 0)
        here = [files[i] for i in sorted(rows_of)] if files else []
        rows = merge_lww(self._rows(table, here), changes.drop(OWNER), key, order, update)
        most = {i: n + (files[i]["rows"] if files else 0) for i, n in rows_of.items()}
        self._write(rows.withColumn(OWNER, place), most, key, f"{self.root}/{folder}")
        fresh = self._listed(folder, key)
        kept = [f for i, f in enumerate(files) if i not in rows_of]
        listed = sorted(kept + fresh, key=lambda f: f["least"])
        return {"schema": table["schema"], "files": listed}, Touched(len(kept), len(here), len(fresh))

    def _write(self, rows: DataFrame, most: dict[int, int], key: list[str], path: str) -> None:
        """One sorted file for each owner, and for one that may have got more than two files' rows: as many as it needs."""
        large = [i for i, n in most.items() if n > 2 * self.file_rows]
        small = [i for i in most if i not in set(large)]
        order = [OWNER, *key]
        if large and small:
            rows = written(rows, "merged")
        if small:
            part = rows.where(~F.col(OWNER).isin(large)) if large else rows
            part.repartition(len(small), OWNER).sortWithinPartitions(*order).write.partitionBy(OWNER).mode("append").parquet(path)
        if large:
            part = rows.where(F.col(OWNER).isin(large)) if small else rows
            n = sum(-(-most[i] // self.file_rows) for i in large)
            part.repartitionByRange(n, *order).sortWithinPartitions(*order).write.partitionBy(OWNER).mode("append").parquet(path)

    def _listed(self, folder: str, key: list[str]) -> list[dict]:
        rows = self.spark.read.parquet(f"{self.root}/{folder}").withColumn("__path", F.col("_metadata.file_path"))
        ends = rows.groupBy("__path").agg(F.min(F.struct(*key)).alias("least"), F.max(F.struct(*key)).alias("greatest"), F.count("*").alias("n"))
        return [{"path": f"{folder}/{r['__path'].split(f'/{folder}/', 1)[1]}", "least": list(r["least"]), "greatest": list(r["greatest"]), "rows": r["n"]} for r in ends.collect()]

    def clean(self, keep: int = 2) -> int:
        """Removes all but the newest versions, and files that none of those has; the number of files that went."""
        numbers = self.versions()
        names = lambda vs: {f["path"] for v in vs for t in self.log.read(v).values() for f in t["files"]}
        gone = names(numbers[:-keep]) - names(numbers[-keep:])
        remove(self.spark, *[f"{self.root}/commits/{v}" for v in numbers[:-keep]], *[f"{self.root}/{p}" for p in gone])
        return len(gone)
