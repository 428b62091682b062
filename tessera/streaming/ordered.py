"""State machines over streams whose rows come in any order: rows wait for the watermark and are then taken in order of time.

A row that is no later than the watermark allows has its place, whatever file or micro-batch it comes in: it waits in its
key's state until nothing earlier can come. Keys without rows are called by a timer once rows of theirs are due. A key that is
idle for longer than `idle_ms` begins anew with its next row; when the watermark has passed that time, its state is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The machine as JSON, the rows that wait (Arrow), and the time of the last row taken, in milliseconds.
STATE = "machine string, waiting binary, last long"


class Machine(Protocol):
    """What a key's rows drive: its state as JSON, and outputs of a row in order of time."""

    def to_json(self) -> str: ...

    def take(self, row, ms: int) -> tuple | None: ...


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes | None) -> pd.DataFrame | None:
    if not data:
        return None
    with pa.ipc.open_stream(data) as source:
        return source.read_all().to_pandas()


def driven(machine, rows: pd.DataFrame, new: Callable[[], Machine], last: int | None, idle_ms: int) -> tuple[Machine, int | None, list[tuple]]:
    """The machine after rows in order, the time of the last one, and what came out."""
    out = []
    for r in rows.itertuples(index=False):
        ms = r.us // 1_000
        if machine is None or last is not None and ms - last > idle_ms:
            machine = new()
        last = ms
        made = machine.take(r, ms)
        if made is not None:
            out.append(made)
    return machine, last, out


def in_order(rows: DataFrame, key: str, columns: list[str], new: Callable[[], Machine], old: Callable[[str], Machine], schema: str, delay: str, idle_ms: int) -> DataFrame:
    """What machines make of a streaming DataFrame of rows (key, ts, seq, columns), each key's in order of (ts, seq). Rows
    later than `delay` behind the newest are dropped; equal rows are taken each. Null keys are left out."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, data, last = state.get if state.exists else (None, None, None)
        parts = [p for p in (unpacked(data), *batches) if p is not None and len(p)]
        watermark = state.getCurrentWatermarkMs()
        waiting = pd.concat(parts).sort_values(["us", "seq"], kind="stable") if parts else None
        machine, out = old(told) if told else None, []
        if waiting is not None:
            due = waiting["us"] <= watermark * 1_000
            machine, last, out = driven(machine, waiting[due], new, last, idle_ms)
            waiting = waiting[~due]
        if waiting is not None and len(waiting):
            state.update((machine.to_json() if machine else None, packed(waiting), last))
            state.setTimeoutTimestamp(int(waiting["us"].iloc[0] // 1_000) + 1)
        elif machine is None or last + idle_ms < watermark:
            if state.exists:
                state.remove()
        else:
            state.update((machine.to_json(), None, last))
            state.setTimeoutTimestamp(max(last + idle_ms, watermark) + 1)
        yield pd.DataFrame(out, columns=names)

    keyed = rows.select(key, "ts", "seq", *columns, F.unix_micros("ts").alias("us")).where(f"{key} IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).groupBy(key)
    return keyed.applyInPandasWithState(task, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
