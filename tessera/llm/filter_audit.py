"""Filter interaction audit by Walsh-Hadamard sums.

Each document has a mask of the filters that it fails. Per part and label cell, one aggregation keeps the 32 sums of
(-1) ** |mask & s|, one for each set s of filters: partial sums in every task, so a part with a third of all rows is 32
numbers like any other. The transform is its own inverse but for a factor of 32, so these sums give back how many
documents have each mask, exactly. What any order of the filters removes at any step follows from those 32 cells alone;
so do the Shapley values: a document that fails k filters is removed by each of them in 120 / k of the 120 orders.

Whether a text is a copy is decided by SHA-256 digests: texts are never shuffled, and a digest that very many rows have is
looked up in a bounded broadcast.

Null texts count as empty, so they are copies of empty ones; a null source is the part ''. A null doc_id is no smaller than
any other and has no labels. Rows repeated with one doc_id are counted each, and are no copies of one another. A doc_id
with several labels has a label of 1 if any is 1. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_values, words, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: White space between words, the least number of words, and signs that ordinary prose has none of.
GAPS, LEAST_WORDS, SIGNS = r"\x20\x09-\x0D", 200, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bits(*failed: Column) -> Column:
    """The number whose k-th bit is the k-th condition."""
    out = F.lit(0)
    for k, f in enumerate(failed):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def text_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    w = words(text, GAPS)
    n, length = F.size(w), F.length(text)
    capitals = length - F.length(F.translate(text, CAPITALS, ""))
    few, repeated = n < LEAST_WORDS, 100 * F.size(F.array_distinct(w)).cast("long") < 50 * n.cast("long")
    return bits(few, repeated, 100 * capitals.cast("long") > 2 * length.cast("long"), text.rlike(SIGNS))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and mask of each row of docs (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("m"))
    rows = written(rows, "audit-rows")
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")), "audit-first")
    rows = with_values(rows, first, ["digest"], "many")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    rows = written(rows.select("doc_id", "part", (F.col("m") + copy).alias("mask")), "audit-masks")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias("good" if c == "quality" else c)
    marks = labels.where("doc_id IS NOT NULL").select("doc_id", "quality", "toxic").groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = with_values(rows, marks, ["doc_id"])
    return rows.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "mask")


def sign(x: Column) -> Column:
    """(-1) to the number of one bits."""
    return F.lit(1) - 2 * F.pmod(F.bit_count(x), F.lit(2))


def cells(rows: DataFrame) -> DataFrame:
    """part, and how many documents have each mask (array<long> of 32): all, those that are good, those that are toxic."""
    sums = [F.sum(sign(F.col("mask").bitwiseAND(F.lit(s)))).alias(f"w{s}") for s in range(MASKS)]
    by_label = rows.groupBy("part", "good", "toxic").agg(*sums)
    kinds = {"n": F.lit(True), "n_good": F.col("good"), "n_toxic": F.col("toxic")}
    parts = by_label.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(has, F.col(f"w{s}"))), F.lit(0)).cast("long") for s in range(MASKS)]).alias(k) for k, has in kinds.items()])
    return parts.select("part", *[inverted(F.col(k)).alias(k) for k in kinds])


def inverted(sums: Column) -> Column:
    """The 32 counts behind 32 signed sums; the division leaves nothing."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    one = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda acc, s: acc + F.get(sums, s) * sign(m.bitwiseAND(s)))
    return F.transform(every, lambda m: F.shiftright(one(m), len(FILTERS)))


def summed(counts: Column, wanted) -> Column:
    """The sum of counts over the masks that `wanted` (of a mask, its count) turns into numbers."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    return F.aggregate(every, F.lit(0).cast("long"), lambda acc, m: acc + wanted(m, F.get(counts, m)))


def untouched(counts: Column, failed: Column) -> Column:
    """How many documents fail none of the filters whose bits `failed` has."""
    return summed(counts, lambda m, n: F.when(m.bitwiseAND(failed) == 0, n).otherwise(0))


def letters(order: Column) -> Column:
    """The bits of a string of filters."""
    one = F.split(order, "")
    return F.aggregate(one, F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord(FILTERS[0]))))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step; kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for every part
    of docs (doc_id, text, source), order of the five filters and step."""
    rows = cells(masked(docs, labels)).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    order, step = F.col("filter_order"), F.col("step")
    rows = rows.withColumn("before", letters(F.substring(order, F.lit(1), step - 1))).withColumn("bit", letters(F.substring(order, step, F.lit(1))))
    before, bit = F.col("before"), F.col("bit")
    lost = lambda k: untouched(F.col(k), before) - untouched(F.col(k), before.bitwiseOR(bit))
    fails = summed(F.col("n"), lambda m, n: F.when(m.bitwiseAND(bit) != 0, n).otherwise(0))
    share = summed(F.col("n"), lambda m, n: F.when(m.bitwiseAND(bit) != 0, F.call_function("div", n * len(ORDERS), F.bit_count(m))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", untouched(F.col("n"), before.bitwiseOR(bit)).alias("kept"), lost("n").alias("removed"),
        (fails - lost("n")).alias("redundant"), F.get("n", bit).alias("unique_fails"), lost("n_good").alias("good_lost"),
        lost("n_toxic").alias("toxic_lost"), share.alias("shapley"),
    )
