"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir).

What is written there is computed once, is safe from lost executors, and cuts lineage.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made within the scopes that are open in this thread or task, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new local folder for a local master (tests); an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in _scopes.get()[-1:]:
        made.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has Spark's cleaner take off the shuffle files that no table in use needs. It does so when their objects are collected
    in the driver, which in a job of many steps may be after all of them, so that their files add up."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the folders made within it; what shall stay is taken off the list. Scopes of other threads are their own."""
    made: list[str] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(before)
        remove(spark, *made)


def numbered(rows: DataFrame, by: Sequence[str], to: str, tag: str = "numbered") -> DataFrame:
    """rows with column `to`: their place, from 0, in the order of `by`.

    The rows are sorted by ranges and written once; their places in the files, and one count for each file, give the
    numbers. (Counts from a second sort would belong to other ranges, for each sort samples bounds of its own.)
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, tag)
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    start, starts = 0, []
    for p, many in sorted(map(tuple, sizes)):
        starts.append((p, start))
        start += many
    first = spark.createDataFrame(starts or [(0, 0)], "__p long, __start long")
    out = placed.withColumn("__p", part).join(F.broadcast(first), "__p")
    return out.withColumn(to, F.col("__start") + within).drop("__at", "__p", "__start")
