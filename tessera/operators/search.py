"""Exact nearest neighbours with votes over several queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A cell of the grid has at most about this many queries and rows: at 128 numbers each, some 8 and 16 MB as read.
QUERY_BLOCK, INDEX_BLOCK = 8_192, 32_768
#: Products are taken this many rows at a time, so a cell's scores have at most 64 MB.
ROWS_AT_ONCE = 1_024
#: Vectors that occur so many times on average are compared once.
COPIES = 2


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the lower row; the rank limit is applied before the shuffle as well."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("row"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def finite(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Which rows' vectors (v) hold finite numbers only, and these as a matrix, by length. Numbers are taken as they lie in
    the batch, without an object for each row."""
    v = pa.concat_arrays(table["v"].chunks) if table.num_rows else None
    if v is None:
        return {}
    n, flat = pc.list_value_length(v).to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    out, starts = {}, np.cumsum(n) - n
    for size in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == size)
        m = flat.reshape(-1, size) if len(at) == len(n) else flat[starts[at][:, None] + np.arange(size)]
        fine = np.isfinite(m).all(axis=1)
        out[size] = at[fine], m if fine.all() else m[fine]
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of two rows each, summed from the first number to the last: equal bits on every machine."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with fields that may be null, as Spark expects what a function returns."""
    return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def taken(column: pa.ChunkedArray, at: np.ndarray) -> pa.ChunkedArray:
    return column.take(pa.array(at)).cast(nullable(column.type))


def best_of_cell(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query. A matrix product finds all rows that may be among them; their scores are then
    summed in order, and ranked by those."""
    out, indexed = [], finite(rows)
    for size, (asked, q) in finite(queries).items():
        if size not in indexed or not len(asked):
            continue
        mine, v = indexed[size]
        row = rows["row"].to_numpy()[mine]
        slack = 4 * size * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0)
        at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)  # query, row and score of the best so far
        for i in range(0, len(v), ROWS_AT_ONCE):
            s = q @ v[i : i + ROWS_AT_ONCE].T
            n = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            a, b = np.nonzero(s >= (least - slack)[:, None])
            exact = np.concatenate([in_order(q[a[j : j + 65_536]], v[i + b[j : j + 65_536]]) for j in range(0, len(a), 65_536)] or [np.zeros(0)])
            a, b, exact = (np.concatenate(x) for x in zip(at, (a, b + i, exact), strict=True))
            order = np.lexsort((row[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            at = a[place < k], b[place < k], exact[place < k]
        good = np.isfinite(at[2])
        a, b, exact = (x[good] for x in at)
        out.append(pa.table([taken(queries["query_id"], asked[a]), taken(rows["row"], mine[b]), taken(rows["id"], mine[b]), pa.array(exact)], ["query_id", "row", "id", "score"]))
    no = np.zeros(0, dtype=np.int64)
    none = pa.table([taken(queries["query_id"], no), taken(rows["row"], no), taken(rows["id"], no), pa.array([], pa.float64())], ["query_id", "row", "id", "score"])
    return pa.concat_tables(out or [none])


def knn_topk(index: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """query_id, rank, row, id, score: the k rows of index (row, id, embedding) with the greatest inner product.

    All rows are compared with every query (query_id, embedding). Both sides are dealt into blocks by hashes, and each
    pair of blocks is a cell of a grid: queries are copied to the blocks of rows, rows to those of queries, so neither
    side passes through the driver or has to fit in one place. A cell gives k rows for each of its queries at most.
    Scores are double precision sums in order of the vectors' numbers, so they have equal bits everywhere. A
    query of another length than a row's, a vector with other than finite numbers, or a score that is none, gives no row.

    Where most vectors of a side are copies of others, each distinct one is compared once for all that have it: equal
    vectors have equal scores, so of rows with one vector the k lowest can be among the best, and queries with one vector
    have the same rows. Both sides are read more than once; rows and query_ids occur once.
    """
    rows = index.where("embedding IS NOT NULL").select(*[F.col(c).alias(a) for c, a in (("row", "row"), ("id", "id"), ("embedding", "v"))])
    asked = queries.where("embedding IS NOT NULL").select(*[F.col(c).alias(a) for c, a in (("query_id", "query_id"), ("embedding", "v"))])
    # an estimate decides only whether copies are worth a shuffle of their own
    counts = [F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("kinds")]
    sizes = [side.agg(*counts).first() for side in (rows, asked)]
    copied = [r["n"] > COPIES * r["kinds"] for r in sizes]
    down, across = (max(1, -(-(r["kinds"] if many else r["n"]) // size)) for r, many, size in zip(sizes, copied, (index_block, query_block), strict=True))
    same_rows = same_queries = None
    if copied[0]:
        lowest = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("row"))).where(F.col("n") <= k)
        kinds = lowest.groupBy("v").agg(F.min(F.struct("row", "id")).alias("first"), F.collect_list(F.struct("row", "id")).alias("same"))
        same_rows = kinds.select(F.col("first.row").alias("row"), "same")
        rows = kinds.select("first.row", "first.id", "v")
    if copied[1]:
        kinds = asked.groupBy("v").agg(F.min("query_id").alias("first"))
        same_queries = asked.join(kinds, "v").select(F.col("first").alias("query_id"), F.col("query_id").alias("each"))
        asked = kinds.select(F.col("first").alias("query_id"), "v")

    def dealt(side: DataFrame, by: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        # both numbers of a cell have one type on both sides: Spark deals a cogroup's sides by hashes, which differ by type
        cells = side.withColumn(mine, F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int"))
        return cells.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("i", "j")

    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "row"), (rows, "id"))}
    schema = f"query_id {kind['query_id']}, row {kind['row']}, id {kind['id']}, score double"
    left, right = dealt(asked, "query_id", "j", across, "i", down), dealt(rows, "row", "i", down, "j", across)
    found = left.cogroup(right).applyInArrow(lambda q, r: best_of_cell(q, r, k), schema)
    if same_rows is not None:
        each = top(found, k).drop("rank").join(same_rows, "row").withColumn("same", F.explode("same"))
        found = each.select("query_id", "same.row", "same.id", "score")
    best = top(found, k)
    if same_queries is not None:
        best = best.join(same_queries, "query_id").withColumn("query_id", F.col("each"))
    return best.select("query_id", "rank", "row", "id", "score")


def vote_frames(candidates: DataFrame, k: int = 10) -> DataFrame:
    """scan_id, rank, id, row, score: mean scores of ids over a scan's frames that have candidates.

    candidates: scan_id, frame, rank, id, row, score. Ties keep the order of first sight. Scores are summed as decimals
    of twelve places, whatever their order; a sum of a million million or more is an error.
    """
    scan = Window.partitionBy("scan_id")
    # sums in decimals do not depend on the order of rows; candidates are read once
    total, seen = F.sum(F.col("score").cast("decimal(24,12)")).cast("double"), F.min(F.struct("frame", "rank", "row"))
    sums = candidates.groupBy("scan_id", "id").agg(total.alias("total"), seen.alias("seen"), F.collect_set("frame").alias("in"))
    frames = F.size(F.array_distinct(F.flatten(F.collect_list("in").over(scan)))).cast("long")
    voted = sums.withColumn("frames", frames).withColumn("score", F.col("total") / F.col("frames"))
    order = Window.partitionBy("scan_id").orderBy(F.desc("score"), F.asc("seen.frame"), F.asc("seen.rank"))
    ranked = voted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("scan_id", "rank", "id", F.col("seen.row").alias("row"), "score", "frames")


def expand_arts(voted: DataFrame, art_of: DataFrame, arts: int = 5) -> DataFrame:
    """scan_id, art_rank, art_id, id, score: the best row of each artwork, the first `arts` of a scan.

    art_of: (id, art_id) of the catalogue; ids that it lacks are skipped.
    """
    known = voted.join(art_of, "id")
    best = known.withColumn("n", F.row_number().over(Window.partitionBy("scan_id", "art_id").orderBy("rank"))).where("n = 1")
    ranked = best.withColumn("art_rank", F.row_number().over(Window.partitionBy("scan_id").orderBy("rank"))).where(F.col("art_rank") <= arts)
    return ranked.select("scan_id", "art_rank", "art_id", "id", "score", "frames")


def top_pair(expanded: DataFrame) -> DataFrame:
    """scan_id, art_id, id, top, second, frames of each scan's best artwork and the runner-up's score."""
    best = F.max_by(F.struct("art_id", "id", "score", "frames"), -F.col("art_rank"))
    out = expanded.groupBy("scan_id").agg(best.alias("best"), F.max(F.when(F.col("art_rank") == 2, F.col("score"))).alias("second"))
    return out.select("scan_id", "best.art_id", "best.id", F.col("best.score").alias("top"), "second", "best.frames")


def best_rotation(candidates: DataFrame, retry_below: float = 0.6) -> DataFrame:
    """Candidates (frame_id, turn, rank, id, row, score) of the orientation that a frame is read in.

    Upright (turn 0) stays unless its best score is below the limit and another orientation's is greater; the first
    greatest one wins.
    """
    tops = candidates.groupBy("frame_id", "turn").agg(F.max("score").alias("top"))
    upright = F.max(F.when(F.col("turn") == 0, F.col("top")))
    pick = F.max_by("turn", F.struct("top", -F.col("turn")))
    chosen = tops.groupBy("frame_id").agg(F.when(upright >= retry_below, F.lit(0)).otherwise(pick).alias("turn"))
    return candidates.join(chosen, ["frame_id", "turn"])
