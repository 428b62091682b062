"""Growing an index: embed what it lacks in one distributed pass, which keeps what it did where it dies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, written
from .catalogue import select_missing
from .merge import append_rows

CHUNK = 1_000
SAVED = "id string, embedding array<float>"
#: A task's file is there as soon as the task ends, not only when all have.
BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def saved_rows(printings: DataFrame, progress: str) -> DataFrame:
    """What earlier runs saved under `progress`, one row for each id."""
    spark = printings.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(progress)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(SAVED).parquet(progress).dropDuplicates(["id"]) if there else spark.createDataFrame([], SAVED)


def fingerprint_missing(printings: DataFrame, pack: DataFrame, embed: Callable[[DataFrame], DataFrame], progress: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The pack (row, id, embedding) with rows for printings (ordinal, id, address) that it lacked, and the new ids.

    `embed` gives id, embedding and error for printings, in parallel, `chunk` of them a task; those with an error are left
    out, and where nothing is new the pack is the one given. Each task's rows are saved under the folder `progress` as it
    ends. What is saved is known by its ids: a run with the same folder embeds what is missing and not saved, be it new or
    failed before, and takes what is saved for the rest. The pack grows once, at the end.
    """
    missing = written(select_missing(printings, pack), "missing")
    left = written(missing.join(saved_rows(printings, progress).select("id"), "id", "left_anti"), "unsaved")
    n = left.count()
    if n:
        done = embed(left.repartition(-(-n // chunk))).where("error IS NULL")  # in the stage that writes: no shuffle follows
        done.select("id", F.col("embedding").cast("array<float>")).write.mode("append").options(**BY_TASK).parquet(progress)
    new = written(saved_rows(printings, progress).join(missing.select("id", F.col("ordinal").alias("row")), "id"), "new")
    if new.isEmpty():
        return pack, pack.select("id").limit(0)
    return append_rows(pack, new.select(*[F.col(c).cast(pack.schema[c].dataType) for c in pack.columns])), new.select("id")


def forget(printings: DataFrame, progress: str) -> None:
    """Removes what runs saved, once the pack that has it is kept."""
    remove(printings.sparkSession, progress)
