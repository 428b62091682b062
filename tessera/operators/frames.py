"""Camera frames from the detector's outputs to candidates: reject, flatten, embed, search, and try other orientations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import image as I
from ..scratch import written
from .scan import first_reading
from .search import best_rotation, knn_topk

#: Orientations in the order in which they are tried: upright, upside down, a quarter to the right, one to the left.
TURNS = (0, 180, 90, 270)
RETRY_BELOW, STRIP_WIDTH = 0.6, 900


def detected(frames: DataFrame, min_area: float = 0.1) -> DataFrame:
    """frames (frame_id, image, raw: eight corner numbers, presence, sharpness) with `detection` and `rejected`."""
    d = G.detection(F.col("raw"), F.col("presence"), F.col("sharpness"), F.col("image.width"), F.col("image.height"))
    rows = frames.withColumn("detection", d)
    return rows.withColumn("rejected", G.frame_rejection(F.col("detection.card_present"), F.col("detection.corners"), min_area))


def process_frames(frames: DataFrame, index: DataFrame, embed: Callable[[Column], Column], k: int = 10, size: int = I.CROP, retry_below: float = RETRY_BELOW) -> tuple[DataFrame, DataFrame]:
    """(frames, candidates). Frames have `detection` and `rejected`; candidates are frame_id, turn, rank, row, id, score
    of those that were not rejected.

    `embed` gives a column of embeddings of a column of square images. All frames are searched upright; only those
    whose best score is below `retry_below` are turned, and searched once more in the three other orientations.
    """
    rows = written(detected(frames), "frames")
    crops = rows.where("rejected IS NULL").select("frame_id", I.dewarp(F.col("image"), F.col("detection.corners"), size).alias("crop"))
    crops = written(crops.select("frame_id", "crop", embed(F.col("crop")).alias("embedding")), "crops")

    def searched(rows: DataFrame) -> DataFrame:
        """Candidates of rows (frame_id, turn, embedding)."""
        found = knn_topk(index, rows.select(F.struct("frame_id", "turn").alias("query_id"), "embedding"), k)
        return found.select("query_id.frame_id", "query_id.turn", "rank", "row", "id", "score")

    upright = written(searched(crops.select("frame_id", F.lit(0).alias("turn"), "embedding")), "upright")
    sure = upright.where((F.col("rank") == 1) & (F.col("score") >= retry_below)).select("frame_id")
    weak = crops.join(sure, "frame_id", "left_anti").select("frame_id", "crop")
    turned = [I.rotate180(F.col("crop")), I.rotate90(F.col("crop")), I.rotate90(F.col("crop"), clockwise=False)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), c.alias("crop")) for i, c in enumerate(turned, 1)]))
    again = weak.select("frame_id", each.alias("t")).select("frame_id", "t.turn", embed(F.col("t.crop")).alias("embedding"))
    found = best_rotation(upright.unionByName(searched(written(again, "again"))), retry_below)
    degrees = F.array(*map(F.lit, TURNS))
    return rows, found.withColumn("turn", F.get(degrees, F.col("turn")))


def read_serials(frames: DataFrame, game: str, recognise: Callable[[Column], Column], width: int = STRIP_WIDTH) -> DataFrame:
    """frame_id, serial, lines, turn: the first of four orientations of a frame (frame_id, image, detection) whose strip
    has a serial, by `recognise`, which gives the lines (array<string>) of a column of images.

    A quarter turn of a card only names its corners anew, so the strip of each orientation is cut out of the frame by
    corners taken in turn.
    """
    region = I.REGIONS[game]
    size = I.strip_size(F.lit(game), width)
    height = frames.sparkSession.range(1).select(size["height"]).first()[0]
    corners = F.col("detection.corners")
    turned = F.array(*[F.struct(F.lit(t).alias("turn"), F.array(*[corners[(i + t) % 4] for i in range(4)]).alias("corners")) for t in range(4)])
    each = frames.select("frame_id", "image", F.explode(turned).alias("t"))
    strips = each.select("frame_id", "t.turn", I.dewarp_region(F.col("image"), F.col("t.corners"), region, width, height).alias("strip"))
    return first_reading(strips.select("frame_id", "turn", recognise(F.col("strip")).alias("lines")))
