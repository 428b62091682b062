"""The labelled training sample that both classifiers fit on, and the fold that is held out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; labels of these rows are never learned. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_ids(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of every labelled document outside the held-out fold."""
    ids = labels.select("doc_id", F.col(label).alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    return ids.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))


def odds_shift(labels: DataFrame, label: str, share: float) -> float:
    """What to add to a logit fitted on a sample with this share of 1, so that it suits the share among all training labels."""
    n, ones = training_ids(labels, label).agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n or not 0 < share < 1:
        return 0.0
    return math.log(ones / (n - ones)) - math.log(share / (1 - share))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` labelled documents of each class, outside the held-out fold.

    The ids are the first ones in hash order, so a sample is the same on every run. Labels other than 0 and 1 and null
    ids are left out; an id with several labels counts as 1 if any is 1, an id with several texts has the first of
    them in text order. The ids are at most 2 * per_class, which bounds the broadcast.
    """
    ids = training_ids(labels, label)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    few = [ids.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few[0].union(few[1])), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
