"""Benchmark decontamination by winnowing, in SQL functions alone.

Documents and items are words of ASCII letters (lower-cased), digits and other signs beyond ASCII. Of the hashes of SEED
consecutive words, the least one of every WINDOW - SEED + 1 neighbours is kept. Two texts that share WINDOW words in a row
share such a group of hashes, so both keep the same one at the same place in it: the join of kept hashes misses no shared
window. A document's hit is then extended to each window of words around it, and a window counts if it is one of an item's,
word for word. Items of fewer than WINDOW words are one window of their own length: every hash of so many words is kept.

Documents with equal texts are looked at once; what is found goes back to all of them by the text's digest. The kept hashes
and windows of items are broadcast if they are BROADCAST_ROWS at most (counted first), and joined by shuffles otherwise;
there, a window that very many documents hold is looked up in a bounded broadcast.

Null texts have no words. Repeated rows give a row each; equal item_ids are one item. A null item_id is the item ''. An
empty table of documents gives no rows, an empty benchmark no hits; extra columns are not read. Texts count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_values, words, written

WINDOW, SEED = 10, 5
#: What joins may broadcast: a row is a number, or WINDOW words.
BROADCAST_ROWS = 500_000
#: Fixed value: the signs of ASCII that are no letters or digits, capitals being lower-cased before.
GAPS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_words(text: Column) -> Column:
    return words(F.translate(text, CAPITALS, CAPITALS.lower()), GAPS)


def fingerprints(w: Column, window: int, seed: int) -> Column:
    """The kept hashes of words w, array<struct<window, seed, p, h>>: the least of each window - seed + 1 neighbours, the
    first of equal ones; p is the place of its first word. Fewer words than a window have none."""
    near = window - seed + 1

    def struct(p: Column, h: Column) -> Column:
        return F.struct(F.lit(window).alias("window"), F.lit(seed).alias("seed"), p.alias("p"), h.alias("h"))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - seed), lambda i: F.xxhash64(F.lit(window), *[F.get(w, i + j) for j in range(seed)]))

    def kept(g: Column) -> Column:
        def least(i: Column) -> Column:
            here = F.slice(g, i + 1, near)
            return i + F.array_position(here, F.array_min(here)).cast("int") - 1

        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - near), least))
        return F.transform(places, lambda p: struct(p, F.get(g, p)))

    # grams are computed once: as the only element of an array that a lambda walks over
    found = F.flatten(F.transform(F.array(grams), kept if near > 1 else lambda g: F.transform(g, lambda h, p: struct(p, h))))
    return F.when(F.size(w) >= window, found)


def levels(items: DataFrame) -> list[tuple[int, int]]:
    """(window, seed) for items (w): the usual one, and one for each length of shorter items, WINDOW - 1 at most."""
    n = F.size("w")
    short = items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()
    return [(WINDOW, SEED)] + sorted((r.n, r.n) for r in short)


def all_fingerprints(w: Column, found: list[tuple[int, int]]) -> Column:
    return F.flatten(F.array_compact(F.array(*[fingerprints(w, *x) for x in found])))


def window_text(w: Column, start: Column, window: Column) -> Column:
    """The window's words, after their number."""
    return F.concat_ws(" ", window.cast("string"), F.slice(w, start + 1, window))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id and each window (as text) of items (item_id, w)."""
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = items.where(F.size("w") > 0).select("*", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("s"))
    return starts.select("item_id", window_text(F.col("w"), F.col("s"), size).alias("window")).distinct()


def small(rows: DataFrame) -> bool:
    return rows.count() <= BROADCAST_ROWS


def hits(texts: DataFrame, kept: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    """tid, w, window, seed, p: the fingerprints of texts (tid, w) that are among kept (h)."""
    own = texts.select("tid", "w", F.explode(all_fingerprints(F.col("w"), found)).alias("f"))
    if small(kept):
        return own.select("tid", "w", "f.*").join(F.broadcast(kept), "h", "left_semi")
    # words don't travel with each hash: places come back to their text
    rows = written(own.select("tid", "f.*").distinct(), "leak-prints")
    met = with_values(rows, kept.withColumn("known", F.lit(True)), ["h"]).where("known")
    places = met.groupBy("tid").agg(F.collect_list(F.struct("window", "seed", "p")).alias("fs"))
    return texts.dropDuplicates(["tid"]).join(places, "tid").select("tid", "w", F.explode("fs").alias("f")).select("tid", "w", "f.*")


def extended(met: DataFrame) -> DataFrame:
    """tid, s, size, window: each window of words around a hit, once."""
    first, last = F.greatest(F.lit(0), F.col("p") + F.col("seed") - F.col("window")), F.least("p", F.size("w") - F.col("window"))
    rows = met.select("tid", "w", F.col("window").alias("size"), F.explode(F.sequence(first, last)).alias("s"))
    return rows.select("tid", "s", "size", window_text(F.col("w"), F.col("s"), F.col("size")).alias("window")).distinct()


def covered(spans: Column) -> Column:
    """How many places the spans (array<struct<s, size>>, sorted) cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        end = x["s"] + x["size"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], x["s"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs (doc_id, text), against benchmark
    (item_id, text)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_words(F.col("text")).alias("w"))
    found = levels(items)
    windows = written(item_windows(items), "leak-windows")
    kept = written(items.select(F.explode(all_fingerprints(F.col("w"), found)).alias("f")).select("f.h").distinct(), "leak-hashes")

    tid = F.unhex(F.md5("text")).alias("tid")
    texts = docs.where("text IS NOT NULL").select(tid, text_words(F.col("text")).alias("w"))
    cand = written(extended(hits(texts, kept, found)), "leak-candidates")
    known = windows.select("window").distinct()
    real = cand.join(F.broadcast(known), "window", "left_semi") if small(known) else with_values(cand, known.withColumn("known", F.lit(True)), ["window"]).where("known")
    real = written(real, "leak-spans")
    spans = real.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("s", "size"))).alias("spans")).select("tid", covered(F.col("spans")).alias("n_hit"))
    pairs = real.select("tid", "window").distinct()
    owned = pairs.join(F.broadcast(windows), "window") if small(windows) else pairs.join(windows, "window")
    lists = owned.groupBy("tid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    result = written(spans.join(lists, "tid").select("tid", "n_hit", F.size("ids").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items")), "leak-texts")

    rows = written(docs.select("doc_id", tid, F.coalesce(F.size(text_words(F.col("text"))), F.lit(0)).alias("n_words")), "leak-rows")
    out = with_values(rows, result, ["tid"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
