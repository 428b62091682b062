"""Exact links between sets of one cluster that are in different components, by blocks.

A cluster holds what may be similar; what is linked already is one component. Components of much data are cut into blocks
of their own, small ones of a cluster are dealt into shared blocks. Every two blocks of a cluster make a cell, unless both
are of one component: so a cluster that is one component but for some stragglers makes as many cells as it has blocks, not
their square. A cell's rows are compared by matrix products of their shingles, in one task of bounded memory, which returns
no pairs but a forest: the links that join components, each only once.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_values, written

#: Shingles of a block, and what a set counts besides its shingles; columns of a matrix at once.
BLOCK, LEAST, COLUMNS = 1 << 16, 64, 4096


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left and each set of right have in common."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    flat = [(np.concatenate([np.zeros(0, dtype=np.int64), *s]), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    both = np.intersect1d(flat[0][0], flat[1][0])
    if not len(both):
        return out
    placed = []
    for values, rows in flat:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        keep = both[at] == values
        order = np.argsort(at[keep], kind="stable")
        placed.append((at[keep][order], rows[keep][order]))
    for lo in range(0, len(both), COLUMNS):
        sides = []
        for (at, rows), sets in zip(placed, (left, right), strict=True):
            s, e = np.searchsorted(at, [lo, lo + COLUMNS])
            m = np.zeros((len(sets), min(COLUMNS, len(both) - lo)), dtype=np.float32)
            m[rows[s:e], at[s:e] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def forest(pairs: Iterable[tuple[int, int]]) -> list[int]:
    """The places of those pairs that join what pairs before have not joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i, (a, b) in enumerate(pairs):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return out


def cell_links(cid: np.ndarray, component: np.ndarray, sets: list[np.ndarray], right: np.ndarray, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """(a, b) of a forest of the links between a cell's two sides (within its one side, if `right` is nowhere true)."""
    of, per = similarity
    l = np.flatnonzero(~right)  # noqa: E741
    r = np.flatnonzero(right) if right.any() else l
    size = np.array([len(x) for x in sets])
    common = intersections([sets[i] for i in l], [sets[i] for i in r]).astype(np.int64)
    union = size[l][:, None] + size[r][None, :] - common
    linked = (per * common >= of * union) & (union > 0) & (component[l][:, None] != component[r][None, :])
    i, j = np.nonzero(linked)
    a, b = l[i], r[j]
    kept = forest(zip(component[a].tolist(), component[b].tolist(), strict=True))
    return [(int(cid[a[k]]), int(cid[b[k]])) for k in kept]


def blocked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (cluster, component, cid, size) with own (the component of a block that is all of one; else null) and h, which
    name their block within the cluster."""
    weight = F.col("size") + LEAST
    each = rows.groupBy("cluster", "component").agg(F.sum(weight).alias("w"), F.count("*").alias("many"))
    large = F.col("w") > block
    small = each.where(~large).groupBy("cluster").agg(F.ceil(F.sum("w") / block).cast("long").alias("deals"))
    each = written(each.join(small, "cluster", "left").select("component", "many", large.alias("large"), F.when(large, F.ceil(F.col("w") / block)).otherwise(F.col("deals")).cast("long").alias("deals")), "tiles-components")
    rows = with_values(rows, each, ["component"], "many")
    dealt = F.when(F.col("large"), F.xxhash64("cid")).otherwise(F.xxhash64("component"))
    return rows.select("cluster", "component", "cid", "size", F.when(F.col("large"), F.col("component")).alias("own"), F.pmod(dealt, F.col("deals")).alias("h"))


def cells(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """cluster, cell, deal, own, h, right: the two sides of every cell of rows (cluster, own, h, size). Cells that are all of
    their cluster share a deal, as many as make a block."""
    blocks = written(rows.groupBy("cluster", F.struct("own", "h").alias("b")).agg(F.sum(F.col("size") + LEAST).alias("w")), "tiles-blocks")
    l, r = blocks.alias("l"), blocks.alias("r")  # noqa: E741
    apart = F.col("l.b.own").isNull() | ~F.col("l.b.own").eqNullSafe(F.col("r.b.own"))
    pairs = l.join(r, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.b") <= F.col("r.b")) & apart)
    pairs = pairs.select(F.col("l.cluster").alias("cluster"), F.col("l.b").alias("a"), F.col("r.b").alias("b"))
    alone = blocks.groupBy("cluster").agg(F.count("*").alias("blocks"), F.sum("w").alias("w")).where("blocks = 1")
    deals = max(1, ceil((alone.agg(F.sum("w")).first()[0] or 0) / block))
    many = blocks.groupBy("cluster").agg(F.count("*").alias("blocks"))
    cell = F.xxhash64("cluster", "a", "b")
    pairs = pairs.join(many, "cluster").select("cluster", "a", "b", cell.alias("cell"), F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(deals))).otherwise(F.lit(deals) + F.pmod(cell, F.lit(1 << 40))).alias("deal"))
    same = F.col("a").eqNullSafe(F.col("b"))
    sides = F.when(same, F.array(F.struct(F.col("a").alias("x"), F.lit(False).alias("right")))).otherwise(F.array(F.struct(F.col("a").alias("x"), F.lit(False).alias("right")), F.struct(F.col("b").alias("x"), F.lit(True).alias("right"))))
    return pairs.select("cluster", "cell", "deal", F.explode(sides).alias("s")).select("cluster", "cell", "deal", "s.x.own", "s.x.h", "s.right")


def links(rows: DataFrame, sets: DataFrame, similarity: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """(a, b): links of that similarity or more between rows (cluster, component, cid, size) of one cluster and different
    components, enough to join all components that are linked. sets (cid, v) has the elements of each."""
    placed = written(blocked(rows, block), "tiles-rows")
    sides = written(cells(placed, block), "tiles-cells")
    here = placed.join(sides, (placed.cluster == sides.cluster) & placed.own.eqNullSafe(sides.own) & (placed.h == sides.h))
    here = here.select("deal", "cell", "right", "cid", "component").join(sets, "cid")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, x in pdf.groupby("cell"):
            found += cell_links(x["cid"].to_numpy(), x["component"].to_numpy(), list(x["v"]), x["right"].to_numpy(dtype=bool), similarity)
        return pd.DataFrame(found, columns=["a", "b"])

    return here.groupBy("deal").applyInPandas(compare, "a long, b long")
