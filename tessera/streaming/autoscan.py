"""When to take a picture: a still scene that differs from the last one taken. As a batch job and as a stream.

Samples are taken in order of (ts, seq) for each camera. In autoscan_stream the order holds within a micro-batch, and a
sample that comes after a later one of its camera has been seen counts when it comes; in autoscan_in_order samples wait for
the watermark, so any order of files gives the batch job's rows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.image import thumbnails
from .ordered import in_order

# Limits of the gate, in brightness, samples and milliseconds.
STILL, CHANGED, STABLE, AWAY, NEVER = 4.0, 10.0, 5, 3, 1000.0
SAMPLE_MS, REPEAT_MS = 120, 30_000
#: How late a sample may come, and after how long without samples a camera begins anew.
DELAY, IDLE_MS = "10 seconds", 600_000

OUT = "camera_id string, ts timestamp, seq long, trigger boolean, kept boolean, still double, changed double"
STATE = "sampled long, prev array<double>, ref array<double>, stable int, away int, armed boolean, kept_at long, kept array<double>"


@dataclass
class Gate:
    """One camera: two run lengths (of still samples, and of samples unlike the last picture) and a latch, which a
    picture closes and a long enough run of unlike samples opens. `kept` is the last scene whose picture was kept: the
    same scene within REPEAT_MS is dropped."""

    sampled: int | None = None
    prev: np.ndarray | None = None
    ref: np.ndarray | None = None
    stable: int = 0
    away: int = 0
    armed: bool = True
    kept_at: int | None = None
    kept: np.ndarray | None = None

    def takes(self, ms: int) -> bool:
        """Whether enough time has gone by since the last sample taken."""
        return self.sampled is None or ms - self.sampled >= SAMPLE_MS

    def repeats(self, ms: int, scene: np.ndarray) -> bool:
        return self.kept_at is not None and ms - self.kept_at < REPEAT_MS and apart(scene, self.kept) < CHANGED

    def step(self, ms: int, scene: np.ndarray) -> tuple[bool, bool, float, float]:
        """(trigger, kept, still, changed) for a sample."""
        motion = NEVER if self.prev is None else float(np.abs(scene - self.prev).mean())
        unlike = NEVER if self.ref is None else apart(scene, self.ref)
        runs = [(n + 1) * on for n, on in ((self.stable, motion <= STILL), (self.away, unlike >= CHANGED))]
        open_latch = self.armed or runs[1] >= AWAY
        fires = open_latch and runs[0] >= STABLE
        keeps = fires and not self.repeats(ms, scene)
        self.sampled, self.prev, self.armed = ms, scene, open_latch and not fires
        self.stable, self.away = (0, 0) if fires else runs
        self.ref = scene if fires else self.ref
        self.kept_at, self.kept = (ms, scene) if keeps else (self.kept_at, self.kept)
        return fires, keeps, motion, unlike

    def take(self, row, ms: int) -> tuple | None:
        return (row.camera_id, row.ts, row.seq, *self.step(ms, np.asarray(row.thumb, dtype=np.float64))) if self.takes(ms) else None

    def to_json(self) -> str:
        return json.dumps(self.to_state())

    @staticmethod
    def from_json(text: str) -> Gate:
        return Gate.from_state(json.loads(text))

    def to_state(self) -> tuple:
        return tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in vars(self).values())

    @staticmethod
    def from_state(values: tuple) -> Gate:
        return Gate(*(np.asarray(v, dtype=np.float64) if isinstance(v, (list, np.ndarray)) else v for v in values))


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """The mean difference of two scenes, each less its own mean."""
    return float(np.abs((a - a.mean()) - (b - b.mean())).mean())


def run(gate: Gate, rows: pd.DataFrame) -> Iterator[tuple]:
    for r in rows.itertuples(index=False):
        ms = int(r.ts.value // 1_000_000)
        if gate.takes(ms):
            yield (r.camera_id, r.ts, r.seq, *gate.step(ms, np.asarray(r.thumb, dtype=np.float64)))


def framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def samples_of(frames: DataFrame) -> DataFrame:
    """Samples (camera_id, ts, seq, thumb) of camera planes (camera_id, ts, seq, plane, width, height, stride, channels,
    green: the place of the green byte in a pixel)."""
    thumb = thumbnails(*[F.col(c) for c in ("plane", "width", "height", "stride", "channels", "green")])
    return frames.select("camera_id", "ts", "seq", thumb.alias("thumb"))


def autoscan_batch(samples: DataFrame) -> DataFrame:
    """OUT for each sample taken of samples (camera_id, ts, seq, thumb).

    A camera's samples stream through one task in order, batch by batch, so only its gate is held in memory.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, gate = None, Gate()
        for b in batches:
            out = []
            for name, rows in itertools.groupby(b.itertuples(index=False), key=lambda r: r.camera_id):
                if name != camera:
                    camera, gate = name, Gate()
                out += run(gate, pd.DataFrame(rows))
            yield framed(out)

    ordered = samples.select("camera_id", "ts", "seq", "thumb").where("camera_id IS NOT NULL").repartition("camera_id")
    return ordered.sortWithinPartitions("camera_id", "ts", "seq").mapInPandas(task, OUT)


def autoscan_stream(samples: DataFrame) -> DataFrame:
    """The same for a streaming DataFrame; each camera's gate is the query's state."""

    def task(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate.from_state(state.get) if state.exists else Gate()
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = list(run(gate, rows))
        state.update(gate.to_state())
        yield framed(out)

    keyed = samples.select("camera_id", "ts", "seq", "thumb").where("camera_id IS NOT NULL").groupBy("camera_id")
    return keyed.applyInPandasWithState(task, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def autoscan_in_order(samples: DataFrame, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same for a streaming DataFrame of samples that come in any order, at most `delay` late (see ordered.in_order)."""
    return in_order(samples, "camera_id", ["thumb"], Gate, Gate.from_json, OUT, delay, idle_ms)
