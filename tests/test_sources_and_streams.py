import datetime as dt
import json
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import image as I
from tessera.sources import feed, index_pack, media_files
from tessera.streaming import autoscan, capture_gate, importer, ordered

START = dt.datetime(2024, 1, 1)


def flat(v):
    return np.full(384, float(v))


def stripes(p, level=100):
    return level + 40 * np.where((np.arange(384) + p) % 2 == 0, 1.0, -1.0)


def nudged(a):
    b = a.copy()
    b[::7] += 6
    return b


SEQUENCES = {
    "held": ([flat(100)] * 6, [5]),
    "too short": ([flat(100)] * 5, []),
    "moving": ([flat(60 if i % 2 else 74) for i in range(40)], []),
    "restarted": ([flat(100)] * 4 + [flat(124)] + [flat(140)] * 6, [10]),
    "long": ([flat(100)] * 200, [5]),
    "changed": ([stripes(0)] * 30 + [nudged(stripes(0))] * 30 + [stripes(1)] * 30, [5, 65]),
    "brightness": ([stripes(0, v) for v in (100, 160, 60) for _ in range(30)], [5]),
    "brief": ([stripes(0)] * 30 + [stripes(1)] * 2 + [stripes(0)] * 30, [5]),
}


def samples(spark):
    rows = [(name, START + dt.timedelta(milliseconds=120 * i), i, t.tolist()) for name, (thumbs, _) in SEQUENCES.items() for i, t in enumerate(thumbs)]
    return spark.createDataFrame(rows, "camera_id string, ts timestamp, seq long, thumb array<double>")


def test_autoscan_triggers(spark):
    got = autoscan.autoscan_batch(samples(spark)).where("trigger").collect()
    assert {n: sorted(r.seq for r in got if r.camera_id == n) for n in SEQUENCES} == {n: want for n, (_, want) in SEQUENCES.items()}


def test_samples_of_camera_planes(spark):
    rows = [("c", START, 0, bytearray([7] * 24 * 64 * 3), 64, 24, 192, 3, 1)]
    frames = spark.createDataFrame(rows, "camera_id string, ts timestamp, seq long, plane binary, width int, height int, stride int, channels int, green int")
    assert autoscan.samples_of(frames).first().thumb == [7.0] * 384


def test_small_differences_are_still(spark):
    gate = autoscan.Gate()
    gate.step(0, flat(100))
    assert gate.step(120, flat(103)) == (False, False, 3.0, autoscan.NEVER)


def test_stream_and_batch_agree(spark, tmp_path):
    rows = samples(spark)
    for part in range(3):  # three files are three micro-batches
        rows.where(F.floor(F.col("seq") / 25) % 3 == part).where(f"seq < {25 * 3}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    writer = autoscan.autoscan_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c")
    writer.trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    batch = autoscan.autoscan_batch(rows.where("seq < 75"))
    both = [sorted((r.camera_id, r.seq, r.trigger, r.kept) for r in df.collect()) for df in (batch, spark.read.parquet(f"file://{tmp_path}/out"))]
    assert both[0] == both[1]


def streamed(spark, make, rows, order, per_file, folder):
    """What a stream makes of rows that come in that order, per_file of them a micro-batch, and a last one much later."""
    for i in range(0, len(order), per_file):
        spark.createDataFrame([rows.rows[j] for j in order[i : i + per_file]], rows.schema).coalesce(1).write.parquet(f"file://{folder}/in/{i:06d}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{folder}/in")
    writer = make(stream).writeStream.format("parquet").option("checkpointLocation", f"file://{folder}/c")
    writer.trigger(availableNow=True).start(f"file://{folder}/out").awaitTermination()
    return [r for r in spark.read.parquet(f"file://{folder}/out").collect() if r.camera_id != "flush"]


class Rows:
    def __init__(self, frame, *last):
        self.schema, self.rows = frame.schema, [*map(tuple, frame.collect()), *last]


def test_samples_in_any_order_give_the_batch_rows(spark, tmp_path):
    """Samples and frames that come scrambled, a camera without rows in a micro-batch, one that is idle, and one that is too late."""
    frame = samples(spark).where("seq < 40 AND camera_id IN ('held', 'moving', 'changed', 'restarted')")
    idle = [("idle", START + dt.timedelta(milliseconds=120 * i + (700_000 if i >= 6 else 0)), i, [100.0] * 384) for i in range(12)]
    rows = Rows(frame, *idle, ("flush", START + dt.timedelta(hours=2), 0, [0.0] * 384))
    rng = np.random.default_rng(4)
    mixed = [*rng.permutation(len(rows.rows) - 1).tolist(), len(rows.rows) - 1]
    want = [(r.camera_id, r.seq, r.trigger, r.kept) for r in autoscan.autoscan_batch(frame).collect()]
    again = [r for r in autoscan.autoscan_batch(spark.createDataFrame(idle[6:], frame.schema)).collect()]
    first = [r for r in autoscan.autoscan_batch(spark.createDataFrame(idle[:6], frame.schema)).collect()]
    want += [(r.camera_id, r.seq, r.trigger, r.kept) for r in first + again]  # anew after so long
    got = streamed(spark, lambda s: autoscan.autoscan_in_order(s, "1 hour"), rows, mixed, 60, tmp_path / "a")
    assert sorted((r.camera_id, r.seq, r.trigger, r.kept) for r in got) == sorted(want) and sum(r.trigger for r in got if r.camera_id == "idle") == 2
    due = sorted(range(len(rows.rows)), key=lambda i: rows.rows[i][1])
    near = [i for j in range(0, len(due), 8) for i in rng.permutation(due[j : j + 8]).tolist()]  # a second late at most
    rows.rows.append(("held", START, 99, [0.0] * 384))  # hours late: dropped
    got = streamed(spark, lambda s: autoscan.autoscan_in_order(s, "3 seconds"), rows, [*near, len(rows.rows) - 1], 60, tmp_path / "b")
    assert sorted((r.camera_id, r.seq, r.trigger, r.kept) for r in got) == sorted(want)


def test_state_of_idle_keys_goes():
    """The machine's calls one by one: rows wait, are due, a timer takes them, and an idle key is removed."""
    calls, made = [], {}

    class State:
        def __init__(self):
            self.value, self.exists, self.watermark, self.timeout = None, False, 0, None

        @property
        def get(self):
            return self.value

        def getCurrentWatermarkMs(self):
            return self.watermark

        def update(self, value):
            self.value, self.exists = value, True

        def remove(self):
            self.value, self.exists = None, False

        def setTimeoutTimestamp(self, ms):
            assert ms > self.watermark
            self.timeout = ms

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def applyInPandasWithState(self, task, *rest):
            made["task"] = task
            return self

    class Machine:
        def take(self, row, ms):
            calls.append(ms)
            return (row.k, row.seq)

        def to_json(self):
            return "m"

    ordered.in_order(Frame(), "k", [], Machine, lambda text: Machine(), "k string, seq long", "1 second", 1_000)
    state, frame = State(), lambda *ms: pd.DataFrame({"k": "a", "ts": pd.to_datetime(list(ms), unit="ms"), "seq": range(len(ms)), "us": [m * 1_000 for m in ms]})
    go = lambda watermark, *parts: setattr(state, "watermark", watermark) or pd.concat(made["task"](("a",), iter(parts), state))["seq"].tolist()
    assert go(0, frame(900, 300, 300)) == [] and state.timeout == 301
    assert go(500, frame(700)) == [1, 2] and state.timeout == 701
    assert go(901) == [0, 0] and calls == [300, 300, 700, 900] and state.timeout == 1_901 and state.exists
    assert go(1_901) == [] and not state.exists
    assert go(1_901, frame(5_000)) == [] and go(6_001) == [0] and not state.exists


def test_repeats_within_half_a_minute_are_dropped():
    gate, kept = autoscan.Gate(), []
    scenes = [stripes(0)] * 6 + [flat(100)] * 8 + [stripes(0)] * 8
    for i, t in enumerate(scenes):
        trigger, keep, *_ = gate.step(120 * i, t)
        kept += [keep] if trigger else []
    assert kept == [True, True, True]
    gate.armed, gate.stable = True, 9  # the same scene again
    assert gate.step(120 * len(scenes), stripes(0))[:2] == (True, False)


def test_capture_gate(spark):
    square = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]
    moved = [(x + 0.1, y) for x, y in square]
    frames = [(square, 20.0, None), (square, 5.0, None), (square, 20.0, None), (moved, 20.0, None), (square, 20.0, "no-card"), (square, 20.0, None), (square, 20.0, None), (square, 20.0, None)]
    rows = [("c", START + dt.timedelta(seconds=i), i, [{"x": x, "y": y} for x, y in q], s, r) for i, (q, s, r) in enumerate(frames)]
    df = spark.createDataFrame(rows, "camera_id string, ts timestamp, seq long, quad array<struct<x:double,y:double>>, sharpness double, rejected string")
    out = capture_gate.capture_gate(df)
    assert [r.reason for r in out.orderBy("seq").collect()] == ["steadying", "blurry", None, "moving", "no-card", "steadying", "steadying", None]
    assert [(r.seq, r.scan) for r in capture_gate.locked_sets(out, wanted=2).orderBy("seq").collect()] == [(2, 0), (7, 0)]


def gate_by_a_loop(frames, restart):
    """The gate and the scans' counter as one plain loop."""
    held, locked, out = [], 0, []
    for seq, (quad, sharp, rejected) in enumerate(frames):
        if rejected:
            held = []
            out.append((seq, rejected, None))
            continue
        held = [*held, quad][-3:]
        far = max((abs(complex(x, y) - complex(*held[0][i])) for q in held[1:] for i, (x, y) in enumerate(q)), default=0)
        reason = "blurry" if sharp < 12 else "steadying" if len(held) < 3 else "moving" if far > 0.04 else None
        out.append((seq, reason, None if reason else locked // 3))
        locked += reason is None
        if restart and reason is None and locked % 3 == 0:
            held = []
    return out


def test_gate_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(8)
    square = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]
    frames = [([(x + float(d), y) for x, y in square], float(s), "no-card" if r < 0.08 else None) for d, s, r in zip(rng.choice([0.0, 0.01, 0.1], 90, p=[0.6, 0.3, 0.1]), rng.choice([5, 20, 30], 90, p=[0.1, 0.5, 0.4]), rng.random(90))]
    rows = [("c", START + dt.timedelta(seconds=i), i, [{"x": x, "y": y} for x, y in q], s, r) for i, (q, s, r) in enumerate(frames)]
    schema = "camera_id string, ts timestamp, seq long, quad array<struct<x:double,y:double>>, sharpness double, rejected string"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(F.floor(F.col("seq") / 30) == part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    for restart in (False, True):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        writer = capture_gate.capture_stream(stream, restart=restart).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c{restart}")
        writer.trigger(availableNow=True).start(f"file://{tmp_path}/out{restart}").awaitTermination()
        got = spark.read.parquet(f"file://{tmp_path}/out{restart}").orderBy("seq").collect()
        assert [(r.seq, r.reason, r.scan) for r in got] == gate_by_a_loop(frames, restart)
    mixed = Rows(df, ("flush", START + dt.timedelta(hours=2), 0, None, 0.0, "x"))
    order = [*np.random.default_rng(3).permutation(90).tolist(), 90]
    got = streamed(spark, lambda s: capture_gate.capture_in_order(s, delay="1 hour"), mixed, order, 30, tmp_path / "mixed")
    assert sorted((r.seq, r.reason, r.scan) for r in got) == gate_by_a_loop(frames, True)
    batch = {r.seq: r.reason for r in capture_gate.capture_gate(df).collect()}
    assert batch == {seq: reason for seq, reason, _ in gate_by_a_loop(frames, False)}


def test_index_pack_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((7, 8)).astype(np.float32)
    rows = [(i, f"art-{i}", v.tolist()) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "row long, id string, embedding array<float>")
    unit = index_pack.unit_rows(matrix)
    for half, tolerance in ((False, 1e-6), (True, 2e-3)):
        path = f"file://{tmp_path}/{half}.bin"
        assert index_pack.write_pack(df, path, half) == 7
        got = index_pack.read_pack(spark, path).orderBy("row").collect()
        assert [r.id for r in got] == [r[1] for r in rows] and np.allclose([r.embedding for r in got], unit, rtol=tolerance, atol=tolerance)
    shards = index_pack.write_shards(df, f"file://{tmp_path}/shards", shard_rows=3).collect()
    assert sorted(r["rows"] for r in shards) == [1, 3, 3]
    (tmp_path / "False.ids").write_text("just\ntwo")
    with pytest.raises(Exception, match="7 rows but 2 ids"):
        index_pack.read_pack(spark, f"file://{tmp_path}/False.bin").collect()
    assert index_pack.read_pack(spark, f"file://{tmp_path}/False.bin", strict=False).count() == 7
    whole = index_pack.read_pack(spark, f"file://{tmp_path}/shards").orderBy("row").collect()  # a folder of packs
    assert [(r.row, r.id) for r in whole] == [(r[0], r[1]) for r in rows]
    assert index_pack.read_pack(spark, f"file://{tmp_path}/none.bin").count() == 0
    assert index_pack.write_pack(df.limit(0), f"file://{tmp_path}/empty.bin") == 0
    assert index_pack.parse_header((tmp_path / "empty.bin").read_bytes())[1:] == (0, 128) and index_pack.read_pack(spark, f"file://{tmp_path}/empty.bin").count() == 0
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    index_pack.check_pair(index_pack.pack_bytes(matrix), "\n".join("abcdefg"))
    with pytest.raises(index_pack.PackError):
        index_pack.check_pair(index_pack.pack_bytes(matrix), "a\nb")
    data = index_pack.pack_bytes(matrix)
    assert index_pack.row_count(data) == 7
    for broken in (data[:10], b"XXXX" + data[4:], data[:8] + b"\x07" + data[9:]):
        with pytest.raises(index_pack.PackError):
            index_pack.parse_header(broken)
    assert index_pack.unit_rows(np.zeros((1, 3))).tolist() == [[0, 0, 0]]


def vectors(spark, first, n, dim=4):
    rng = np.random.default_rng(first)
    return spark.createDataFrame([(first + i, f"id {first + i}", v.tolist()) for i, v in enumerate(rng.standard_normal((n, dim)).astype(np.float32))], "row long, id string, embedding array<float>")


def shown_packs(spark, folder):
    return [(r.row, r.id, [round(x, 3) for x in r.embedding]) for r in index_pack.read_pack(spark, folder).orderBy("row").collect()]


def unit_of(*frames):
    return [(r.row, r.id, [round(x, 3) for x in index_pack.unit_rows(np.array([r.embedding], dtype=np.float32))[0].tolist()]) for f in frames for r in f.orderBy("row").collect()]


def test_packs_of_a_folder_are_committed_together(spark, tmp_path):
    folder, path = f"file://{tmp_path}/set", tmp_path / "set"
    first, more = vectors(spark, 0, 25), vectors(spark, 25, 9)
    index_pack.save_packs(first.repartition(5), folder, half=False, shard_rows=4)
    assert shown_packs(spark, folder) == unit_of(first) and index_pack.check_digests(folder) == 25
    index_pack.save_packs(more, folder, half=False, shard_rows=4, append=True)
    assert shown_packs(spark, folder) == unit_of(first, more) and all(p.rows <= 4 for p in index_pack.tagged(folder))
    before = sorted(str(p) for p in path.rglob("*") if not p.name.startswith("."))

    def dying(batches):
        for b in batches:
            if (b["row"] == 7).any():
                raise RuntimeError("the task dies")
            yield b

    for bad, said in ((first.mapInPandas(dying, first.schema), "dies"), (first.where("row <> 3"), "gaps|begins"), (more, "begins"), (first.withColumn("id", F.lit("a\nb")), "an id is")):
        with pytest.raises(Exception, match=said):
            index_pack.save_packs(bad, folder, half=False, shard_rows=4)
        assert shown_packs(spark, folder) == unit_of(first, more)
        time.sleep(2)  # tasks that were still running
        index_pack.clean(folder, seconds=0)
        assert sorted(str(p) for p in path.rglob("*") if not p.name.startswith(".")) == before  # nothing of it stays
    index_pack.save_packs(more.withColumn("row", F.col("row") - 25), folder, half=False)
    assert len(shown_packs(spark, folder)) == 9 and len(list(path.rglob("*.bin"))) == 1
    (ids,) = path.rglob("*.ids")
    whole = ids.read_bytes()
    ids.write_bytes(whole.replace(b"id 26", b"id 62"))
    with pytest.raises(index_pack.PackError, match="torn"):
        index_pack.check_digests(folder)
    ids.write_bytes(whole[:-3])
    with pytest.raises(Exception, match="torn"):
        index_pack.read_pack(spark, folder).collect()
    none = f"file://{tmp_path}/none"
    index_pack.save_packs(first.limit(0), none)
    assert index_pack.tagged(none) == [] and index_pack.read_pack(spark, none).count() == 0


def test_a_tag_is_stored_once_a_pair_is_checked(spark, tmp_path):
    source, target = f"file://{tmp_path}/games/g/index-20240101.bin", f"file://{tmp_path}/phone/g.bin"
    assert index_pack.write_pack(vectors(spark, 0, 3), source) == 3
    assert index_pack.stale(target, "t1") and index_pack.install(source, target, "t1") == 3
    assert not index_pack.stale(target, "t1") and not index_pack.stale(target, None) and index_pack.stale(target, "t2")
    (tmp_path / "games/g/index-20240101.ids").write_text("one")
    with pytest.raises(index_pack.PackError):
        index_pack.install(source, target, "t2")
    assert index_pack.stale(target, "t1") and index_pack.stale(target, "t2")  # torn: fetched again
    keys = spark.createDataFrame([("games/g/index-20240101.bin",), ("games/g/index-20250101.bin",), ("games/h/index-20240101.bin",)], "key string")
    index_pack.write_pack(vectors(spark, 0, 3), source)
    got = lambda game, at: index_pack.load_existing(spark, f"file://{tmp_path}", keys, game, at).count()
    assert (got("g", "20240601"), got("g", "20231231"), got("h", "20240601"), got("x", "20240601")) == (3, 0, 0, 0)


def test_feed_files(spark, tmp_path):
    group = {"groupId": 7, "name": "n", "abbreviation": None, "publishedOn": "2024"}
    (tmp_path / "g.json").write_text(json.dumps({"success": True, "errors": [], "results": [group]}))
    (tmp_path / "e.json").write_text(json.dumps({"success": True}))
    assert [r.groupId for r in feed.groups(spark, f"file://{tmp_path}/g.json").collect()] == [7]
    assert feed.price_guide(spark, f"file://{tmp_path}/e.json", "idProduct bigint, avg double").count() == 0
    (tmp_path / "7.json").write_text(json.dumps({"results": [{"productId": 1, "marketPrice": 2.5}]}))
    assert [(r.groupId, r.pos, r.marketPrice) for r in feed.prices(spark, f"file://{tmp_path}/7.json").collect()] == [(7, 0, 2.5)]


def test_resumable_import(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(gid):
        product = {"productId": gid * 10, "name": f"Card {gid}", "cleanName": f"Card {gid}", "imageUrl": "u", "groupId": gid, "extendedData": [{"name": "Number", "displayName": "n", "value": f"{gid}/9"}]}
        body = {"group": {"groupId": gid, "name": f"G{gid}", "abbreviation": f"S{gid}", "publishedOn": "2024"}, "products": [product], "prices": [{"productId": gid * 10, "marketPrice": 1.0 * gid}]}
        (landing / f"{gid}.json").write_text(json.dumps(body))

    def go():
        importer.run_import(spark, "onepiece", f"file://{landing}", f"file://{tmp_path}/root", f"file://{tmp_path}/c", per_batch=1)
        return {n: t.count() for n, t in importer.catalogue(spark, f"file://{tmp_path}/root").read().items()}

    land(1), land(2)
    assert go() == {"sets": 2, "cards": 2, "printings": 2, "prices": 2}
    land(3)
    assert go() == {"sets": 3, "cards": 3, "printings": 3, "prices": 3}
    assert spark.read.json(f"file://{tmp_path}/root/reports").count() == 3
    batch = spark.read.schema(importer.SCHEMA).option("multiLine", "true").json(f"file://{landing}/3.json")
    importer.import_batch("onepiece", batch, f"file://{tmp_path}/root", 2)  # the last batch taken again
    assert tuple(importer.totals(spark, f"file://{tmp_path}/root").first()) == (3, 3, 3, 0)
    land(4)
    paths = importer.run_refresh(spark, "onepiece", f"file://{landing}", f"file://{tmp_path}/root", f"file://{tmp_path}/c", "20240801", dt.datetime(2024, 8, 1), per_batch=2)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["catalog-20240801.json"]
    versions = importer.Snapshots(spark, f"file://{tmp_path}/root/versions").read()["versions"].collect()
    assert [(r.game_id, r.version, r.printings_count) for r in versions] == [("onepiece", "20240801", 4)]


def test_an_import_rewrites_the_files_that_it_touches(spark, tmp_path):
    """Twelve groups into a catalogue of many: some files of each table change, the rest stay as they are."""

    def batch(gids, price):
        rows = []
        for gid in gids:
            products = [{"productId": gid * 10 + i, "name": f"Card {gid} {i}", "cleanName": f"Card {gid} {i}", "imageUrl": "u", "groupId": gid, "extendedData": [{"name": "Number", "displayName": "n", "value": f"{i}/9"}]} for i in range(5)]
            rows.append(json.dumps({"group": {"groupId": gid, "name": f"G{gid}", "abbreviation": f"S{gid:05d}", "publishedOn": "2024"}, "products": products, "prices": [{"productId": gid * 10 + i, "marketPrice": price} for i in range(5)]}))
        return spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", importer.SCHEMA).alias("x")).select("x.*")

    root = f"file://{tmp_path}/root"
    importer.import_batch("onepiece", batch(range(600), 1.0), root, 0, file_rows=100)
    touched = importer.import_batch("onepiece", batch(range(301, 313), 2.0), root, 1, file_rows=100)
    for name in ("sets", "printings", "prices"):
        assert touched[name].replaced <= 3 and touched[name].kept >= 3, name
    tables = importer.catalogue(spark, root).read()
    assert {n: t.count() for n, t in tables.items()} == {"sets": 600, "cards": 3000, "printings": 3000, "prices": 3000}
    assert tables["prices"].where("market = 2").count() == 60


def test_a_pass_goes_on_from_its_cursor(spark, tmp_path, monkeypatch):
    """Killed before and after each of its commits, a pass ends as one that was not; groups that land meanwhile wait."""
    from tessera.operators import commits
    from tessera.streaming import passes

    def land(folder, gids):
        folder.mkdir(exist_ok=True)
        for gid in gids:
            products = [{"productId": gid * 10 + i, "name": f"Card {gid} {i}", "cleanName": f"Card {gid} {i}", "imageUrl": "u", "groupId": gid, "extendedData": [{"name": "Number", "displayName": "n", "value": f"{i}/9"}] if i else []} for i in range(3)]
            body = {"group": {"groupId": gid, "name": f"G{gid}", "abbreviation": f"S{gid}", "publishedOn": "2024"}, "products": products, "prices": [{"productId": gid * 10 + i, "marketPrice": 1.5 * gid} for i in range(3)]}
            (folder / f"{gid}.json").write_text(json.dumps(body))

    def pass_of(name, batch):
        return passes.Passes(spark, "onepiece", f"file://{tmp_path}/{name}-landing", f"file://{tmp_path}/{name}", batch)

    def rows(name):
        return {n: sorted(str(r) for r in t.drop("updated_at", "as_of").collect()) for n, t in importer.catalogue(spark, f"file://{tmp_path}/{name}").read().items()}

    now, gids = dt.datetime(2024, 8, 1), [100, 9, 20, 3, 7]
    land(tmp_path / "a-landing", gids), land(tmp_path / "b-landing", gids)
    whole = pass_of("a", 100).run("20240801", now)
    assert (whole.run, whole.cursor, whole.total, whole.sets, whole.printings, whole.unmatched, whole.version) == (1, 5, 5, 5, 10, 5, "20240801")
    cut, write = pass_of("b", 2), commits.CommitLog.write

    def die(after):
        def at(log, number, content):
            if after:
                write(log, number, content)
            raise RuntimeError("killed")

        monkeypatch.setattr(commits.CommitLog, "write", at)
        with pytest.raises(RuntimeError, match="killed"):
            cut.step("20240801", now)
        monkeypatch.undo()

    seen = []
    for after in (False, True):
        die(after)
        state = cut.step("20240801", now)
        seen.append((state.run, state.cursor))
        if not after:
            assert [r.gid for r in cut.listing(1).orderBy("place").collect()] == sorted(gids)
            land(tmp_path / "b-landing", [1, 50])  # while the pass is under way
    while not state.done:
        state = cut.step("20240801", now)
    assert seen[0] == (1, 2) and seen[1][1] > 2 and {f: getattr(state, f) for f in ("run", "cursor", "total", *passes.COUNTS)} == {f: getattr(whole, f) for f in ("run", "cursor", "total", *passes.COUNTS)}
    assert rows("b") == rows("a")
    again = cut.run("20240802", dt.datetime(2024, 8, 2))
    assert (again.run, again.total, again.sets) == (2, 7, 7) and len(rows("b")["sets"]) == 7
    assert sorted(p.name for p in (tmp_path / "b/packs/games/onepiece").iterdir() if p.suffix == ".json") == ["catalog-20240801.json", "catalog-20240802.json", "delta-20240801-20240802.json"]


def test_image_functions(spark):
    a = np.arange(4 * 5 * 4, dtype=np.uint8).reshape(4, 5, 4)
    a[..., 3] = 255
    df = spark.createDataFrame([(bytearray(a.tobytes()), 5, 4), (None, None, None)], I.IMAGE).select(F.struct("data", "width", "height").alias("image"))
    turned = df.select(I.rotate90(F.col("image")).alias("t")).collect()[0].t
    assert (turned.width, turned.height) == (4, 5)
    assert np.array_equal(np.frombuffer(turned.data, np.uint8).reshape(5, 4, 4), np.rot90(a, -1))
    half = df.select(I.rotate180(I.rotate180(F.col("image"))).alias("t")).collect()
    assert bytes(half[0].t.data) == a.tobytes() and half[1].t.data is None
    assert df.select(I.sharpness(F.col("image")).alias("s")).collect()[0].s == 0.0  # a plane has no edges
    assert I.laplacian_variance(a[:2]) == 0.0
    same = I.flatten(a, [{"x": 0, "y": 0}, {"x": 0.8, "y": 0}, {"x": 0.8, "y": 0.75}, {"x": 0, "y": 0.75}], 4)
    assert np.array_equal(same[0, 0], a[0, 0]) and same.shape == (4, 4, 4)
    assert I.crop(a, 0.9, 0.9, 1, 1).shape[:2] == (1, 1) and I.shrink(a, 2).shape[:2] == (2, 2) and I.shrink(a, 9) is a
    assert I.argb(np.array([[[1, 2, 3, 0]]], dtype=np.uint8)).tolist() == [int(np.uint32(0xFF010203).view(np.int32))]
    assert I.tensor(a).shape == (60,)
    thumb = I.thumbnail(bytes(64 * 48 * 3), 64, 48, 64 * 3, 3, 1)
    assert len(thumb) == I.THUMB_COLS * I.THUMB_ROWS and not thumb.any()
    plane = np.array([[[3, 2, 1, 9]]], dtype=np.uint8)
    assert I.from_plane(plane.tobytes(), 1, 1, 4, True).tolist() == [[[1, 2, 3, 255]]]


def naive_bilinear(a, x, y):
    """One sampled colour, by the textbook formula with the edge repeated."""
    h, w = a.shape[:2]
    x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
    i, j = int(x), int(y)
    k, m, u, v = min(i + 1, w - 1), min(j + 1, h - 1), x - i, y - j
    return [int((a[j, i, c] * (1 - u) + a[j, k, c] * u) * (1 - v) + (a[m, i, c] * (1 - u) + a[m, k, c] * u) * v) for c in range(3)]


def test_image_functions_against_pixel_loops(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (9, 7, 4), dtype=np.uint8)
    df = spark.createDataFrame([(bytearray(a.tobytes()), 7, 9), (None, None, None)], I.IMAGE).select(F.struct("data", "width", "height").alias("image"))

    def shown(column):
        first, second = (r[0] for r in df.select(column).collect())
        assert second is None or not isinstance(second, list) and second.data is None
        return np.frombuffer(first.data, np.uint8).reshape(first.height, first.width, 4) if hasattr(first, "data") else first

    small = shown(I.squash_resize(F.col("image"), 4))
    for y in range(4):
        for x in range(4):
            assert small[y, x].tolist() == [*naive_bilinear(a, (x + 0.5) * 7 / 4 - 0.5, (y + 0.5) * 9 / 4 - 0.5), 255]
    part = shown(I.crop_normalised(F.col("image"), 0.3, 0.2, 0.5, 0.4))  # from (2, 2): 2.1 and 1.8; 3.5 and 3.6 pixels
    assert np.array_equal(part[..., :3], a[2:6, 2:6, :3])
    less = shown(I.downscale(F.col("image"), 3))  # 3 x 4 from 7 x 9
    assert less.shape == (4, 3, 4) and all(less[y, x, :3].tolist() == a[min(8, int(y * 7 / 3)), min(6, int(x * 7 / 3)), :3].tolist() for y in range(4) for x in range(3))
    mean, deviation = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    want = [(a[y, x, c] / 255 - mean[c]) / deviation[c] for c in range(3) for y in range(9) for x in range(7)]
    assert np.allclose(shown(I.to_tensor(F.col("image"))), want, atol=1e-6)
    words = [int.from_bytes(bytes([255, *a[y, x, :3].tolist()]), "big", signed=True) for y in range(9) for x in range(7)]
    assert shown(I.to_argb(F.col("image"))) == words
    quad = F.expr("array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(1D AS x, 1D AS y), struct(0D AS x, 1D AS y))")
    strip = shown(I.dewarp_region(F.col("image"), quad, (0.0, 0.5, 1.0, 0.5), 7, 2))
    for y in range(2):
        for x in range(7):
            assert np.abs(np.array(naive_bilinear(a, x + 0.5, (0.5 + (y + 0.5) / 4) * 9)) - strip[y, x, :3]).max() <= 1
    plane = rng.integers(0, 256, (50, 40 * 3 + 8), dtype=np.uint8)
    rows = spark.createDataFrame([(bytearray(plane.tobytes()), 40, 50, 128, 3, 1)], "p binary, w int, h int, s int, c int, g int")
    thumb = rows.select(I.thumbnails(*[F.col(c) for c in "pwhscg"]).alias("t")).first().t
    for row, col in ((0, 0), (11, 7), (23, 15)):
        cy, cx = int((row + 0.5) * 50 / 24), int((col + 0.5) * 40 / 16)
        cells = [plane[min(49, max(0, cy + dy - 2)), min(39, max(0, cx + dx - 2)) * 3 + 1] for dy in range(4) for dx in range(4)]
        assert thumb[row * 16 + col] == np.mean(cells)
    frame = media_files.camera_frames(spark.createDataFrame([(bytearray([3, 2, 1, 9]), 1, 1, 4, True, "k")], "plane binary, width int, height int, stride int, bgra boolean, note string")).first()
    assert list(frame.image.data) == [1, 2, 3, 255] and frame.note == "k"


def sinc_by_loops(a, width, height):
    """One row after another, then one column after another, from the window's formula."""

    def line(values, target):
        n, out = len(values), []
        scale = n / target
        wide = max(scale, 1)
        for i in range(target):
            d = [(j + 0.5 - (i + 0.5) * scale) / wide for j in range(n)]
            w = [1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if abs(x) < 3 else 0.0 for x in d]
            out.append(min(255, max(0, math.floor(sum(p * q for p, q in zip(w, values)) / sum(w) + 0.5))))
        return out

    rows = [[line([int(a[y, x, c]) for x in range(a.shape[1])], width) for c in range(3)] for y in range(a.shape[0])]
    columns = [[line([rows[y][c][x] for y in range(a.shape[0])], height) for c in range(3)] for x in range(width)]
    return np.array(columns).transpose(2, 0, 1)


def test_sinc_resampling_against_loops(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (11, 7, 4), dtype=np.uint8)
    frame = spark.createDataFrame([(bytearray(a.tobytes()), 7, 11), (None, None, None)], I.IMAGE).select(F.struct("data", "width", "height").alias("image"))
    for width, height in ((3, 4), (20, 5), (7, 30), (1, 1)):
        first, second = (r[0] for r in frame.select(I.sinc_resize(F.col("image"), width, height)).collect())
        got = np.frombuffer(first.data, np.uint8).reshape(height, width, 4)
        assert np.abs(got[..., :3].astype(int) - sinc_by_loops(a, width, height)).max() <= 1 and (got[..., 3] == 255).all() and second.data is None
    plane = np.full((500, 700, 4), 77, dtype=np.uint8)
    assert np.unique(I.resample(plane, I.MODEL_SIZE, I.MODEL_SIZE)[..., :3]).tolist() == [77] and I.tensor(I.resample(plane, 448, 448)).shape == (3 * 448 * 448,)


def test_small_sources(spark, tmp_path):
    product = {"productId": 1, "name": "n", "groupId": 7, "extendedData": [{"name": "Number", "displayName": "d", "value": "1"}]}
    (tmp_path / "p.json").write_text(json.dumps({"success": True, "results": [product, product]}))
    assert [(r.pos, r.productId, r.extendedData[0]["value"]) for r in feed.products(spark, f"file://{tmp_path}/p.json").collect()] == [(0, 1, "1"), (1, 1, "1")]
    game = {"game": "g", "version": "2", "printingsCount": 3, "deltas": [{"from": "1", "to": "2", "url": "u"}]}
    (tmp_path / "m.json").write_text(json.dumps({"version": "2", "games": [game]}))
    assert [(r.game, r.deltas[0]["from"]) for r in feed.manifest(spark, f"file://{tmp_path}/m.json").collect()] == [("g", "1")]
    assert {r.path.rsplit("/", 1)[1]: r.length > 0 for r in feed.stored_keys(spark, f"file://{tmp_path}").collect()} == {"p.json": True, "m.json": True}
    assert {r.game: r.category for r in feed.category_of(spark).collect()}["pokemon"] == 3


def test_strip_sizes(spark):
    got = spark.createDataFrame([("onepiece",), ("mtg",)], "g string").select(I.strip_size(F.col("g"), 900).alias("s")).collect()
    assert [(r.s.width, r.s.height) for r in got] == [(900, 189), (900, 293)]


def jpeg(marker):
    return bytes([0xFF, 0xD8, 0xFF, 0xE0, 0, 4, 0, 0, 0xFF, 0xFF, marker, 0, 11, 8, 0, 50, 0, 80, 0, 0, 0])


def test_jpeg_headers(spark, tmp_path):
    assert I.jpeg_dimensions(jpeg(0xC0)) == I.jpeg_dimensions(jpeg(0xC2)) == (80, 50)
    assert I.jpeg_dimensions(b"nothing") is None and I.jpeg_dimensions(None) is None and I.jpeg_dimensions(jpeg(0xC4)) is None
    (tmp_path / "a.jpg").write_bytes(jpeg(0xC0))
    (tmp_path / "b.jpg").write_bytes(b"no")
    got = {r.path[-5:]: (r.width, r.rejected) for r in media_files.jpeg_files(spark, f"file://{tmp_path}", 100).collect()}
    assert got == {"a.jpg": (80, "too-large"), "b.jpg": (None, "no-header")}


def test_embedding_skips_what_fails(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "id string, address string").coalesce(1)
    got = media_files.embedded(rows, float, lambda xs: np.array([[x, x] for x in xs])).collect()
    assert {r.id: r.embedding for r in got} == {"a": [1.0, 1.0], "b": None, "c": [3.0, 3.0]} and [r.id for r in got if r.error] == ["b"]
