"""Is a card held still and in focus: over the last three frames of a camera, and sets of locked frames."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .autoscan import DELAY, IDLE_MS
from .ordered import in_order

FRAMES, DRIFT, SHARP = 3, 0.04, 12.0


def capture_gate(frames: DataFrame, order: tuple[str, ...] = ("ts", "seq"), n: int = FRAMES, drift: float = DRIFT, sharp: float = SHARP) -> DataFrame:
    """frames (camera_id, order, quad, sharpness, rejected) with `reason`: null is locked.

    A rejected frame starts the history anew and has its own reason. Others: blurry, then steadying until n frames have
    come, then moving if a corner of a later frame is further than `drift` from the oldest one's.
    """
    by = Window.partitionBy("camera_id").orderBy(*order)
    rows = frames.withColumn("__run", F.sum(F.col("rejected").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    here = Window.partitionBy("camera_id", "__run").orderBy(*order)
    # the rejected frame itself is the first row of its run and no part of the history
    rows = rows.withColumn("__quad", F.when(F.col("rejected").isNull(), F.col("quad")))
    first = F.lag("__quad", n - 1).over(here)
    later = [F.lag("__quad", i).over(here) if i else F.col("__quad") for i in range(n - 1)]

    def moved(quad: Column) -> Column:
        far = F.lit(False)
        for c in range(4):
            far = far | (F.hypot(quad[c]["x"] - F.col("__first")[c]["x"], quad[c]["y"] - F.col("__first")[c]["y"]) > drift)
        return far

    rows = rows.withColumn("__first", first)
    for i, quad in enumerate(later):
        rows = rows.withColumn(f"__later{i}", quad)
    any_moved = F.lit(False)
    for i in range(n - 1):
        any_moved = any_moved | moved(F.col(f"__later{i}"))
    reason = F.coalesce("rejected", F.when(F.col("sharpness") < sharp, "blurry").when(F.col("__first").isNull(), "steadying").when(any_moved, "moving"))
    return rows.withColumn("reason", reason).drop("__run", "__quad", "__first", *[f"__later{i}" for i in range(n - 1)])


def locked_sets(gated: DataFrame, order: tuple[str, ...] = ("ts", "seq"), wanted: int = FRAMES) -> DataFrame:
    """Locked frames with the scan they belong to: every `wanted` of a camera in order are one scan; an incomplete last
    one is left out. Rejected frames between them do not matter."""
    by = Window.partitionBy("camera_id").orderBy(*order)
    rows = gated.where("reason IS NULL").withColumn("scan", F.floor((F.row_number().over(by) - 1) / wanted))
    whole = rows.withColumn("__n", F.count("*").over(Window.partitionBy("camera_id", "scan")))
    return whole.where(F.col("__n") == wanted).drop("__n")


STREAMED = "camera_id string, ts timestamp, seq long, reason string, scan long"
STATE = "held array<double>, locked long"


class Locks:
    """One camera: its last n quads, and how many frames were locked."""

    def __init__(self, n: int, drift: float, sharp: float, wanted: int, restart: bool, held: Sequence[float] = (), locked: int = 0):
        self.n, self.drift, self.sharp, self.wanted, self.restart, self.locked = n, drift, sharp, wanted, restart, locked
        self.quads = list(np.asarray(held, dtype=np.float64).reshape(-1, 4, 2))

    def take(self, row, ms: int) -> tuple:
        """The row of STREAMED for the next frame."""
        reason = row.rejected if isinstance(row.rejected, str) else None
        if reason is None:
            self.quads = [*self.quads, np.array([(p["x"], p["y"]) for p in row.quad])][-self.n :]
            apart = np.linalg.norm(np.array(self.quads[1:]).reshape(-1, 4, 2) - self.quads[0], axis=2)
            reason = "blurry" if row.sharpness < self.sharp else "steadying" if len(self.quads) < self.n else "moving" if (apart > self.drift).any() else None
        else:
            self.quads = []
        out = (row.camera_id, row.ts, row.seq, reason, None if reason else self.locked // self.wanted)
        self.locked += reason is None
        if self.restart and reason is None and self.locked % self.wanted == 0:
            self.quads = []
        return out

    def held(self) -> list[float]:
        return np.array(self.quads).ravel().tolist()

    def to_json(self) -> str:
        return json.dumps([self.held(), self.locked])


def capture_in_order(frames: DataFrame, n: int = FRAMES, drift: float = DRIFT, sharp: float = SHARP, wanted: int = FRAMES, restart: bool = True, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """As capture_stream, for frames that come in any order, at most `delay` late (see ordered.in_order). A camera that
    begins anew after idle_ms counts its scans from 0 again."""
    make = lambda *held: Locks(n, drift, sharp, wanted, restart, *held)
    return in_order(frames, "camera_id", ["quad", "sharpness", "rejected"], make, lambda text: make(*json.loads(text)), STREAMED, delay, idle_ms)


def capture_stream(frames: DataFrame, n: int = FRAMES, drift: float = DRIFT, sharp: float = SHARP, wanted: int = FRAMES, restart: bool = True) -> DataFrame:
    """STREAMED for a streaming DataFrame of frames (camera_id, ts, seq, quad, sharpness, rejected): capture_gate's
    reason, and for a locked frame the number of the scan that it belongs to, `wanted` frames each.

    With `restart` the history starts anew after each whole scan, as it does after a rejected frame. A camera's last n
    quads and its count of locked frames are the query's state. Frames are taken in order within a
    micro-batch; one that comes after a later one of its camera counts when it comes. The last scan may be incomplete.
    """

    def task(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, locked = state.get if state.exists else ([], 0)
        locks = Locks(n, drift, sharp, wanted, restart, held, locked)
        out = [locks.take(r, 0) for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False)]
        state.update((locks.held(), locks.locked))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STREAMED.split(", ")]).astype({"scan": "Int64"})

    keyed = frames.select("camera_id", "ts", "seq", "quad", "sharpness", "rejected").where("camera_id IS NOT NULL").groupBy("camera_id")
    return keyed.applyInPandasWithState(task, STREAMED, STATE, "append", GroupStateTimeout.NoTimeout)
