"""Near-duplicate embeddings by sorted projection passes.

Vectors of equal labels (and equal length) link at a cosine of `threshold` or more, in double precision. Equal vectors
are one class with a number of copies, so copies cost nothing however many there are.

1. Each of `passes` passes orders the classes lexicographically by 64 concatenated random hashes (signs of projections
   of its own). Ranks in that order are cut into blocks of BLOCK, each with the first `window` rows of the next, so a
   block is a bounded task whatever the labels; each vector is verified against its next `window` neighbours. What is
   verified in a block leaves it as one edge for each vector, to the first of its local component.
2. The edges of all passes are united into connected components.
3. A window cannot hold all partners of a vector within a dense component, so links are counted exactly there: each
   component is dealt into tiles of about TILE classes, every two tiles meet in one task, and partial counts are added
   up. Pairs are never emitted.

A link is missed only if no pass brings its two components together. A pair at the threshold agrees on k signs with
probability (1 - acos(threshold) / pi) ** k, and shares a window when k signs leave no more vectors than it holds, so
the number of passes grows with the logarithm of the largest label's number of vectors: `passes_for` keeps the computed
share of pairs met at RECALL, and PASSES is the least.

Null vectors, those with null or non-finite cells, zero vectors, empty ones and those without a label link with
nothing. Null ids come after all others when a component is named; a component without any id is named null. Repeated
rows are vectors like any other; an empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, with_values, written

PASSES, RECALL, WINDOW, BLOCK, TILE, SEED = 8, 0.999, 64, 1024, 1024, 11
BITS = 64


def unit(vectors) -> np.ndarray:
    """Rows of length 1, in double precision."""
    v = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(vectors: np.ndarray, passes: int, seed: int = SEED) -> np.ndarray:
    """The signs of each pass's projections, the first in the highest bit, as one long per pass."""
    planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], passes * BITS))
    bits = (vectors @ planes > 0).reshape(len(vectors), passes, BITS)
    return np.packbits(bits, axis=2).view(">i8").astype(np.int64)[:, :, 0]


def classes_of(rows: DataFrame) -> DataFrame:
    """cid, h1, h2, label, dim, v, copies, rep of each distinct valid vector of a label; rep is the smallest vec_id."""
    of = rows.where("valid").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    return written(of.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "label", F.size("v").alias("dim"), "v", "copies", "rep"), "embedding-classes")


def passes_for(vectors: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a lone pair at the threshold has shared a window with this probability, among so many vectors."""
    signs = math.ceil(math.log2(max(1.0, vectors / window)))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** signs
    return PASSES if together == 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The first row of each row's component, of n rows linked by a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def edges(classes: DataFrame, threshold: float, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(a, b): from each class to the first of its component within a block, over all passes."""
    spark = classes.sparkSession

    @F.pandas_udf("array<long>")
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = [None] * len(s)
            for _, same in s.groupby(s.map(len)):
                for i, c in zip(same.index, codes(unit(same), passes), strict=True):
                    out[i] = c
            yield pd.Series(out)

    each = classes.select("cid", "label", "dim", "v", F.posexplode(coded("v")).alias("pass", "code"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "dim", "code", "cid"]
    placed = each.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "embedding-order")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # as many rows as partitions
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    start = spark.createDataFrame(sorted(starts.items()) or [(0, 0)], "p long, start long")
    ranked = placed.withColumn("p", part).join(F.broadcast(start), "p").withColumn("rank", F.col("start") + within)
    own = (F.col("rank") / block).cast("long")
    blocks = F.when((F.col("rank") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = ranked.select("cid", "pass", "label", "dim", "v", "rank", F.explode(blocks).alias("block"))

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        out = []
        for _, run in g.groupby(["pass", "label", "dim"], sort=False):
            if len(run) < 2:
                continue
            v, cid = unit(run["v"]), run["cid"].to_numpy()
            i, j = np.nonzero(v @ v.T >= threshold)
            near = (j > i) & (j - i <= window)
            root = local_roots(i[near], j[near], len(run))
            to = root != np.arange(len(run))
            out.append(pd.DataFrame({"a": cid[to], "b": cid[root[to]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return dealt.groupBy("block").applyInPandas(verify, "a long, b long").distinct()


def links_within(members: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(cid, links): vectors of other classes that a class links with, among the members (cid, v, copies, component, size)."""
    tiles = F.ceil(F.col("size") / tile)
    small = int(members.where(F.col("size") <= tile).count() // (4 * tile)) + 1
    mine = F.pmod(F.xxhash64("cid"), tiles)
    one = F.array(F.struct(F.lit(-1).cast("long").alias("i"), F.pmod(F.xxhash64("component"), F.lit(small)).alias("j")))
    other = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda t: F.struct(F.least(t, F.col("mine")).alias("i"), F.greatest(t, F.col("mine")).alias("j")))
    dealt = members.withColumn("mine", mine).withColumn("key", F.explode(F.when(tiles == 1, one).otherwise(other)))
    # small components share a task; the tiles of a large one are tasks of their own
    dealt = dealt.select("cid", "v", "copies", "component", "mine", F.when(F.col("key.i") < 0, F.lit(-1)).otherwise(F.col("component")).alias("c"), "key.i", "key.j")

    def count(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in g.groupby("component", sort=False):
            v, copies, cid = unit(x["v"]), x["copies"].to_numpy(), x["cid"].to_numpy()
            links = v @ v.T >= threshold
            np.fill_diagonal(links, False)
            if x["i"].iat[0] != x["j"].iat[0] and x["i"].iat[0] >= 0:  # two tiles: only what lies between them
                here = x["mine"].to_numpy()
                links &= here[:, None] != here[None, :]
            out.append(pd.DataFrame({"cid": cid, "links": links @ copies}))
        return pd.concat(out)

    return dealt.groupBy("c", "i", "j").applyInPandas(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, passes: int | None = None, window: int = WINDOW, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label); passes_for the largest label
    unless their number is given."""
    cells = F.col("embedding")
    fine = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(cells, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", cells.alias("v"), F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)).alias("valid"))
    # 128 bits of content name a class
    rows = rows.select("*", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(SEED), "v", "label").alias("h2"))
    classes = classes_of(rows)
    if passes is None:
        largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
        passes = passes_for(largest or 0, threshold, window)
    found = written(connected_components(edges(classes, threshold, passes, window, block)), "embedding-components")
    named = found.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    sizes = named.groupBy("component").agg(F.count("*").alias("size"), F.min("rep").alias("low"))
    members = written(classes.select("cid", "v", "copies").join(found.withColumnRenamed("node", "cid"), "cid").join(sizes, "component"), "embedding-members")
    links = links_within(members, threshold, tile)
    known = classes.join(members.select("cid", "low", F.lit(True).alias("linked")), "cid", "left").join(links, "cid", "left")
    known = known.select("h1", "h2", "copies", F.when(F.col("linked"), F.col("low")).otherwise(F.col("rep")).alias("low"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    # copies of one vector may be a large share of all rows
    valid = with_values(rows.where("valid").select("vec_id", "h1", "h2"), known, ["h1", "h2"], "copies").select("vec_id", F.col("n").alias("n_links"), F.col("low").alias("component_id"))
    rest = rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
