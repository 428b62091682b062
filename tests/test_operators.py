import datetime as dt
import json
import os
import time
from concurrent.futures import ThreadPoolExecutor
from threading import Event

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import catalogue, changes, collection, commits, merge, names, publish, ranged, scan, search
from tessera.scratch import written

ITEM = "array<struct<name:string,displayName:string,value:string>>"
GROUPS = [(23425, "Five Hundred Years", "OP07", "2024-06-28"), (23024, "Wings of the Captain", "OP06", "2024-03-15")]
PRODUCTS = [
    (23024, 0, 545001, "Monkey.D.Luffy (Alternate Art)", "Monkey D Luffy", "u1", [("Number", "Card Number", "OP06-069"), ("Rarity", "Rarity", "SR")]),
    (23024, 1, 545002, "Nami (Foil)", "Nami", "u2", [("Number", "n", "OP06-020"), ("Rarity", "r", "R")]),
    (23024, 2, 545003, "Wings of the Captain Booster Box", "Wings Booster Box", "u3", []),
    (23425, 0, 556001, "Monkey.D.Luffy", "Monkey D Luffy", "u4", [("Number", "n", "OP07-119"), ("x", "Rarity", "L")]),
    (23425, 1, 556002, "Uta", "Uta", "u5", [("Number", "n", "025/120"), ("Rarity", "r", "C")]),
]
PRICES = [(23024, 0, 545001, 184.32, 160.0), (23024, 1, 545002, 1.42, 0.95), (23024, 2, 545003, 89.99, 85.0), (23024, 3, 545099, None, None), (23425, 0, 556001, 12.5, 9.99), (23425, 1, 556002, 0.11, 0.05)]


def feed(spark, now="2024-07-01"):
    groups = spark.createDataFrame(GROUPS, "groupId long, name string, abbreviation string, publishedOn string")
    products = spark.createDataFrame(PRODUCTS, f"groupId long, pos int, productId long, name string, cleanName string, imageUrl string, extendedData {ITEM}")
    prices = spark.createDataFrame(PRICES, "groupId long, pos int, productId long, marketPrice double, lowPrice double")
    return catalogue.import_feed("onepiece", groups, products, prices, F.lit(now).cast("timestamp"))


def test_import_of_a_feed_and_again(spark):
    new = feed(spark)
    first = {n: t.cache() for n, t in catalogue.merged(catalogue.empty_tables(new), new).items()}
    assert {n: t.count() for n, t in first.items()} == {"sets": 2, "cards": 3, "printings": 4, "prices": 4}
    assert new.report().first().asDict() == {"sets": 2, "printings": 4, "unmatched": 1, "prices": 5}
    assert new.unmatched.select("reason", "payload").collect() == [("no-number", '{"productId":545003,"name":"Wings of the Captain Booster Box"}')]
    rows = {r["id"]: r for r in first["printings"].collect()}
    assert rows["onepiece:OP06:OP06069:normal:en"]["card_id"] == rows["onepiece:OP07:OP07119:normal:en"]["card_id"]
    assert rows["onepiece:OP07:25:normal:en"]["set_total"] == "120" and "onepiece:OP06:OP06020:foil:en" in rows
    again = catalogue.merged(first, feed(spark, "2024-08-01"))
    assert {n: t.count() for n, t in again.items()} == {n: t.count() for n, t in first.items()}
    art = again["cards"].where("name = 'Monkey D Luffy'").first()["art_id"]
    assert art == "onepiece:monkey d luffy:OP06|OP06069|monkey d luffy"  # the first writer's
    old, late = (publish.delta_pack(again, "onepiece", F.lit(d).cast("timestamp")) for d in ("2000-01-01", "2100-01-01"))
    assert [old[n].count() for n in ("sets", "cards", "printings", "prices")] == [0, 3, 4, 4]
    assert [late[n].count() for n in ("cards", "printings", "prices")] == [0, 0, 0]
    assert {n: df.count() for n, df in publish.full_pack(again, "onepiece").items()} == {"sets": 2, "cards": 3, "printings": 4, "prices": 4}


def test_published_packs(spark, tmp_path):
    new = feed(spark)
    tables = catalogue.merged(catalogue.empty_tables(new), new)
    paths = publish.publish(tables, "onepiece", "20240701", f"file://{tmp_path}", ("20240601", F.lit("2000-01-01").cast("timestamp")))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["catalog-20240701.json", "delta-20240601-20240701.json"]
    whole = json.loads((tmp_path / "games/onepiece/catalog-20240701.json").read_text())
    assert [len(whole[n]) for n in publish.SECTIONS] == [2, 3, 4, 4, 0] and (whole["from"], whole["to"]) == (None, "20240701")
    assert {"id": "onepiece:OP07", "gameId": "onepiece", "code": "OP07", "name": "Five Hundred Years", "releaseDate": "2024-06-28"} in whole["sets"]
    back = publish.read_pack(spark, paths[0])
    for name in publish.RENAMED:
        want = tables[name].select(*[c for c in publish.RENAMED[name] if c in tables[name].columns])
        got = back[name].select(*[F.col(c).cast(want.schema[c].dataType) for c in want.columns])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert publish.publish(tables, "onepiece", "20240701", f"file://{tmp_path}", ("20240701", F.lit(None)))[1:] == []
    gone = spark.createDataFrame([("a\"b",), ("c",)], "id string")
    publish.write_pack({n: t.limit(0) for n, t in publish.full_pack(tables, "onepiece").items()} | {"removed": gone}, f"file://{tmp_path}/r.json", "g", "1", "2")
    assert json.loads((tmp_path / "r.json").read_text())["removedPrintings"] == ['a"b', "c"]
    assert sorted(r.id for r in publish.read_pack(spark, f"file://{tmp_path}/r.json")["removed"].collect()) == ['a"b', "c"]


def test_commas_between_rows(spark):
    rows = [(d, *r) for d in (0, 1) for r in [(0, 0, "h"), (1, 0, "["), (1, 1, "a"), (1, 1, "b"), (1, 1, "c"), (1, 2, "]"), (2, 0, "["), (2, 1, "d"), (2, 2, "]")]]
    out = publish.with_commas(spark.createDataFrame(rows[::-1], "doc int, section int, kind int, value string").repartition(3))
    got = {}
    for r in out.collect():
        got[r.doc] = got.get(r.doc, "") + r.value
    assert got == {0: "h[a,b,c][d]", 1: "h[a,b,c][d]"}


def test_names_are_found_by_their_pieces(spark):
    """As ILIKE over all rows: short patterns, wildcards, escapes, repeated names, signs beyond ASCII, nulls."""
    words = ["Blue Bolt", "blue bolt", "BOLT", "Öl", "öl lamp", "100% sure", "a_b", "a", "", None, "ring\\ring", "x" * 40]
    rows = spark.createDataFrame([(str(i), n) for i, n in enumerate(words)], "id string, name string")
    texts = ["o", "ol", "OLT", "bolt", "Ö", "ö", "", "%", "_", "%%", "b%t", "e_b", "100\\%", "a\\_", "xxx", "zzz", "blue bolt and more", None]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")
    got = names.search_names(names.name_index(rows), rows, queries, limit=5)
    want = [(i, r.id) for i, t in enumerate(texts) if t is not None for r in rows.where(F.col("name").ilike(f"%{t}%")).orderBy("name", "id").limit(5).collect()]
    assert [(r.query_id, r.id) for r in got.orderBy("query_id", "place").collect()] == want and len(want) > 40
    met = names.pieces_of(F.lit("Bolt%ab_c"))
    assert sorted(rows.limit(1).select(met.alias("p")).first().p) == ["ab", "bol", "c", "olt"]


def test_versions_of_a_game(spark, tmp_path):
    new = feed(spark)
    tables = catalogue.merged(catalogue.empty_tables(new), new)
    none = spark.createDataFrame([], "game_id string, version string, printings_count long, index_pack_key string, created_at timestamp")
    paths, versions = publish.publish_next(tables, none, "onepiece", "1", dt.datetime(2024, 1, 1), f"file://{tmp_path}")
    assert len(paths) == 1 and [tuple(r) for r in versions.collect()] == [("onepiece", "1", 4, None, dt.datetime(2024, 1, 1))]
    paths, versions = publish.publish_next(tables, versions, "onepiece", "2", dt.datetime(2025, 1, 1), f"file://{tmp_path}")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["catalog-2.json", "delta-1-2.json"] and versions.count() == 2
    delta = publish.read_pack(spark, paths[1])
    assert delta["printings"].count() == 4 and delta["sets"].count() == 0  # all were written after the first version


rows = st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.integers(0, 9))), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_merge_against_a_plain_loop(spark, base, changes):
    base = list({k: (k, a, b) for k, a, b in base}.values())
    want = {k: [a, b] for k, a, b in base}
    for k, a, b in changes:
        want.setdefault(k, [a, b])[1] = b
    b = spark.createDataFrame(base, "k int, first int, last int")
    c = spark.createDataFrame([(*r, i) for i, r in enumerate(changes)], "k int, first int, last int, seq int")
    once = merge.merge_lww(b, c, ["k"], "seq", ["last"])
    assert {r.k: [r.first, r.last] for r in once.collect()} == want
    assert {r.k: [r.first, r.last] for r in merge.merge_lww(once, c, ["k"], "seq", ["last"]).collect()} == want


def test_additive_missing_delete_and_set(spark):
    base = spark.createDataFrame([(1, "p", "normal", "NM", 2, 1.0)], "portfolio_id int, printing_id string, variant string, condition string, quantity long, cost_basis double")
    more = spark.createDataFrame([(1, "p", "normal", "NM", 3, 9.0, 0), (1, "p", "foil", "NM", 1, 4.0, 1)], "portfolio_id int, printing_id string, variant string, condition string, quantity long, cost_basis double, seq int")
    got = {r.variant: (r.quantity, r.cost_basis) for r in collection.add_entries(base, more).collect()}
    assert got == {"normal": (5, 1.0), "foil": (1, 4.0)}
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, merge.insert_missing(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, merge.delete_keys(a, b, ["k"]).collect())) == [(1, "a")]
    assert sorted(map(tuple, merge.set_where(a, b, "k", v=F.lit("z")).collect())) == [(1, "a"), (2, "z")]


def test_append_rows(spark):
    pack = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)], "row long, id string, v double")
    new = spark.createDataFrame([(0, "b", 9.0), (1, "d", 4.0), (2, "d", 5.0)], "row long, id string, v double")
    assert [tuple(r) for r in merge.append_rows(pack, new).orderBy("row").collect()] == [(0, "a", 1.0), (1, "c", 3.0), (2, "b", 9.0), (3, "d", 4.0), (4, "d", 5.0)]
    assert merge.append_rows(pack.limit(0), new.limit(0)).count() == 0


def test_rows_are_numbered_without_gaps_in_many_partitions(spark):
    """Far more rows than a sort samples: kept ones first, then new ones, each in order."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        pack = spark.range(400_000).select(F.col("id").alias("row"), (F.col("id") * 31 % 400_009).alias("id"), F.col("id").alias("old"))
        out = merge.append_rows(pack, pack.where("row % 7 = 0")).persist()
        n = F.count("*"), F.countDistinct("row"), F.min("row"), F.max("row")
        assert tuple(out.agg(*n).first()) == (400_000, 400_000, 0, 399_999)
        w = Window.partitionBy(F.floor(F.col("row") / 20_000)).orderBy("row")
        new, before_ = (F.col("old") % 7 == 0).cast("int"), F.lag(F.struct((F.col("old") % 7 == 0).cast("int"), "old")).over(w)
        assert out.withColumn("fine", before_.isNull() | (before_ < F.struct(new, "old"))).where("NOT fine").count() == 0
        assert out.where("old % 7 <> 0").agg(F.max("row")).first()[0] == 400_000 - 57_143 - 1
        out.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_snapshots(spark, tmp_path):
    store = merge.Snapshots(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.write({"a": spark.range(3), "b": spark.range(1)}) == 1
    old = store.read()
    assert store.write({"a": old["a"].where("id > 0"), "b": old["b"]}) == 2  # reads one version while it writes the next
    assert store.versions() == [1, 2] and {n: t.count() for n, t in store.read().items()} == {"a": 2, "b": 1} and store.read(1)["a"].count() == 3
    (tmp_path / "t" / "v3-left").mkdir()  # never committed
    assert store.versions() == [1, 2]
    assert publish.sync_store(store, []) == 3 and store.read()["a"].count() == 2
    store.prune(keep=2)
    assert store.versions() == [2, 3] and store.read(2)["a"].count() == 2
    with pytest.raises(Exception):
        store.read(1)
    late, folders = merge.Snapshots(spark, f"file://{tmp_path}/t"), sorted(os.listdir(tmp_path / "t"))
    late.log.newest = lambda: 2  # another writer that has not seen the third version
    with pytest.raises(FileExistsError):
        late.write({"a": spark.range(9)})
    with pytest.raises(FileExistsError):
        store.write({"a": spark.range(9)}, base=2)
    assert store.read()["a"].count() == 2 and sorted(os.listdir(tmp_path / "t")) == folders


def test_a_writer_that_dies_leaves_the_newest_version(spark, tmp_path, monkeypatch):
    """At each of its steps: in a table, between the tables, in the commit's part, and just before the commit."""
    store = merge.Snapshots(spark, f"file://{tmp_path}/t")
    store.write({"a": spark.range(3), "b": spark.range(1)})

    def bad(df):
        return df.select(F.when(F.col("id") > 0, F.raise_error("dies")).otherwise(F.col("id").cast("string")).alias("id"))

    for tables in ({"a": bad(spark.range(9)), "b": spark.range(1)}, {"a": spark.range(9), "b": bad(spark.range(9))}):
        with pytest.raises(Exception, match="dies"):
            store.write(tables)
        assert store.versions() == [1] and store.read()["a"].count() == 3
    monkeypatch.setattr(commits, "put_if_absent", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write({"a": spark.range(9)})
    monkeypatch.undo()
    assert len(list((tmp_path / "t").glob("v*"))) == 1
    (tmp_path / "t/commits/_0.part").write_text('{"fol')  # a part that was never given its name
    assert store.versions() == [1] and store.read()["a"].count() == 3
    assert store.write({"a": spark.range(4)}) == 2 and store.read()["a"].count() == 4


def test_one_of_many_writers_makes_a_commit(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: commits.put_if_absent(spark, f"file://{tmp_path}/c/1", f"{i}".encode() * 1000), range(16)))
    assert sum(made) == 1 and (tmp_path / "c/1").read_text() == f"{made.index(True)}" * 1000
    assert [n for n in os.listdir(tmp_path / "c") if not n.startswith(".")] == ["1"]


KEYED = "k string, n long, first string, last string"


def test_a_merge_touches_the_files_of_its_keys(spark, tmp_path):
    store = ranged.RangedTables(spark, f"file://{tmp_path}/r", {"t": ["k", "n"], "u": ["k"]}, file_rows=100)
    assert store.read() == {} and store.versions() == []
    base = spark.range(1_000).select(F.format_string("k%04d", F.col("id")).alias("k"), (F.col("id") % 3).alias("n"), F.lit("1").alias("first"), F.lit("1").alias("last"), F.lit(0).alias("seq"))
    update = {"t": ["last"], "u": ["last"]}
    done = store.merge({"t": base, "u": base.limit(5)}, "seq", update)
    assert done["t"].replaced == 0 and 8 <= done["t"].written <= 12 and done["u"].written == 1
    few = spark.createDataFrame([("k0500", 2, "2", "2", 0), ("k0500", 9, "2", "2", 0), ("k0501", 0, "2", "2", 0), ("a", 0, "2", "2", 0), ("k0500", 2, "3", None, 1)], f"{KEYED}, seq int")
    files = done["t"].written
    done = store.merge({"t": few}, "seq", update)["t"]
    assert done.replaced in (2, 3) and done.kept == files - done.replaced  # the first file, and one or two in the middle
    want = merge.merge_lww(merge.merge_lww(base.drop("seq").limit(0), base, ["k", "n"], "seq", ["last"]), few, ["k", "n"], "seq", ["last"])
    assert sorted(map(str, store.read()["t"].collect())) == sorted(map(str, want.collect())) and store.read(1)["t"].count() == 1_000 and store.read()["u"].count() == 5
    listed = store.commit()["t"]["files"]
    assert all(a["greatest"] < b["least"] for a, b in zip(listed, listed[1:], strict=False)) and sum(f["rows"] for f in listed) == want.count()
    more = spark.range(900).select(F.format_string("k0500x%03d", F.col("id")).alias("k"), F.lit(1).cast("long").alias("n"), F.lit("4").alias("first"), F.lit("4").alias("last"), F.lit(0).alias("seq"))
    done = store.merge({"t": more}, "seq", update)["t"]
    assert done.replaced == 1 and done.written >= 8  # one file becomes many
    assert store.merge({"t": few.limit(0)}, "seq", update)["t"] == ranged.Touched(len(store.commit()["t"]["files"]), 0, 0)
    before = store.read()["t"].count()
    assert before == want.count() + 900 and store.clean(keep=2) > 0 and store.versions() == [3, 4] and store.read()["t"].count() == before
    late = ranged.RangedTables(spark, f"file://{tmp_path}/r", {"t": ["k", "n"]}, file_rows=100)
    late.log.newest = lambda: 3
    folders = sorted(os.listdir(tmp_path / "r"))
    with pytest.raises(FileExistsError):
        late.merge({"t": few}, "seq", update)
    assert sorted(os.listdir(tmp_path / "r")) == folders and store.read()["t"].count() == before


def test_scopes_of_threads_are_their_own(spark):
    from tessera import scratch

    opened, done = Event(), Event()

    def other():
        with scratch.scope(spark) as made:
            opened.set()
            done.wait(60)
            return len(made)

    with ThreadPoolExecutor(1) as pool, scratch.scope(spark) as mine:
        later = pool.submit(other)
        opened.wait(60)
        rows = scratch.written(spark.range(5), "x")
        done.set()
        assert later.result() == 0 and len(mine) == 1 and rows.count() == 5


def test_scratch_tables(spark):
    from tessera import scratch

    with scratch.scope(spark) as made:
        rows = scratch.written(spark.range(5), "x")
        kept = scratch.new_dir(spark, "y")
        made.remove(kept)
        assert rows.count() == 5 and len(made) == 1
        path = made[0]
    assert not os.path.exists(path.removeprefix("file://"))
    assert scratch.numbered(spark.range(0), ["id"], "n").count() == 0


def test_search_and_votes(spark):
    index = spark.createDataFrame([(0, "a", [1.0, 0.0, 0.0]), (1, "b", [0.0, 1.0, 0.0]), (2, "c", [0.9, 0.1, 0.0]), (3, "d", [0.0, 0.0, 1.0])], "row long, id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<float>")
    for blocks in ({}, {"query_block": 1, "index_block": 2}):
        got = search.knn_topk(index, queries, 3, **blocks).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id) for r in got] == [(1, "a"), (1, "c"), (1, "b")] and got[0].score == pytest.approx(1.0)
        assert search.knn_topk(index.limit(0), queries, 3, **blocks).count() == 0
    odd = spark.createDataFrame([(0, "n", None), (1, "x", [float("inf"), 0.0, 0.0]), (2, "e", [])], index.schema)
    assert search.knn_topk(odd, queries.unionByName(odd.select(F.col("row").alias("query_id"), "embedding")), 3).count() == 0
    frames = [(1, 0, 1, "lucky", 9, 0.2), (1, 1, 1, "lucky", 9, 0.1), (1, 2, 1, "lucky", 9, 0.95), (1, 0, 2, "steady", 4, 0.7), (1, 2, 2, "steady", 5, 0.72)]
    votes = search.vote_frames(spark.createDataFrame(frames, "scan_id long, frame int, rank int, id string, row long, score double")).orderBy("rank").collect()
    assert [(r.id, r.row) for r in votes] == [("steady", 4), ("lucky", 9)] and votes[0].score == pytest.approx(1.42 / 3)
    art = spark.createDataFrame([("steady", "x"), ("lucky", "x")], "id string, art_id string")
    voted = search.vote_frames(spark.createDataFrame(frames, "scan_id long, frame int, rank int, id string, row long, score double"))
    assert [(r.art_rank, r.id) for r in search.expand_arts(voted, art).collect()] == [(1, "steady")]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=15), st.integers(1, 5))
def test_top_k_against_a_full_sort(spark, vectors, k):
    index = spark.createDataFrame([(i, str(i), [float(x) for x in v]) for i, v in enumerate(vectors)], "row long, id string, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, embedding array<float>")
    want = [i for _, i in sorted((-(v[0] + 2 * v[1]), i) for i, v in enumerate(vectors))][:k]
    assert [r.row for r in search.knn_topk(index, queries, k).orderBy("rank").collect()] == want
    assert [r.row for r in search.knn_topk(index, queries, k, index_block=4).orderBy("rank").collect()] == want


def test_scores_are_sums_in_order(spark):
    """Copies tie to the lower row, and a score is the plain loop's to the last bit."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((2_500, 37))
    v[rng.integers(0, 2_500, 900)] = v[7]
    index = spark.createDataFrame([(i, str(i), x.tolist()) for i, x in enumerate(v)], "row long, id string, embedding array<double>")
    asked = index.where("row % 500 = 7").select(F.col("row").alias("query_id"), "embedding")

    def plain(a, b):
        s = 0.0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            s += x * y
        return s

    got = search.knn_topk(index, asked, 40, index_block=900).collect()
    for q in (7, 507, 1007):
        want = sorted((-plain(v[q], x), i) for i, x in enumerate(v))[:40]
        assert [(-r.score, r.row) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_cells_meet_in_every_partition(spark, uncoalesced):
    """both sides of a cell go to one task, also where tasks are many and adaptive execution joins none."""
    v = np.random.default_rng(7).integers(-9, 9, (400, 5)).astype(float)
    index = spark.createDataFrame([(i, str(i), x.tolist()) for i, x in enumerate(v)], "row long, id string, embedding array<float>")
    asked = index.where("row % 25 = 0").select(F.col("row").alias("query_id"), "embedding")
    want = {q: sorted((-float(v[q] @ x), i) for i, x in enumerate(v))[:5] for q in range(0, 400, 25)}
    for blocks in ({}, {"index_block": 60}, {"query_block": 3, "index_block": 60}):
        got = search.knn_topk(index, asked, 5, **blocks).collect()
        assert {q: [(-r.score, r.row) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == want


def test_matched_first_sorts_artworks_not_matches(spark):
    """places come from one order of each artwork; what the join with the wanted makes is not sorted or shuffled."""
    rows = [(f"{n:02d}", f"art:{n % 3}", f"20{20 + n % 5}-01-01" if n % 4 else None, str(n % 2)) for n in range(24)]
    ids = [*[f"{n:02d}" for n in range(0, 24, 2)], "02", "none"]
    df = spark.createDataFrame(rows, "id string, art_id string, release_date string, number string")
    got = catalogue.matched_first(df, spark.createDataFrame([(i,) for i in ids], "id string"))
    want = []
    for i in set(ids) - {"none"}:
        art = [r for r in rows if r[1] == f"art:{int(i) % 3}"]
        newest = sorted(sorted(art, key=lambda r: (r[3], r[0])), key=lambda r: r[2] or "", reverse=True)
        want += [(i, n, r[0]) for n, r in enumerate(sorted(newest, key=lambda r: r[0] != i), 1)]
    assert sorted(tuple(r) for r in got.select("wanted", "place", "id").collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_copies_are_compared_once(spark, uncoalesced):
    """equal vectors are searched once for all that have them, and give the rows of a full sort."""
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, (12, 3)).astype(float)[rng.integers(0, 12, 300)]
    index = spark.createDataFrame([(i, str(i), x.tolist()) for i, x in enumerate(v)], "row long, id string, embedding array<float>")
    asked = index.select(F.struct("row", F.lit(0).alias("turn")).alias("query_id"), "embedding")
    for k in (1, 4, 60):
        found = search.knn_topk(index, asked, k)
        got = found.collect()
        for q in range(0, 300, 7):
            want = sorted((-float(v[q] @ x), i) for i, x in enumerate(v))[:k]
            mine = sorted((r for r in got if r.query_id.row == q), key=lambda r: r.rank)
            assert [(-r.score, r.row) for r in mine] == want and [r.rank for r in mine] == list(range(1, k + 1)) and all(r.id == str(r.row) for r in mine)
    lone = index.where("row < 5").withColumn("embedding", F.transform("embedding", lambda x: x + F.col("row") / 8))
    plan = [search.knn_topk(i, q, 4)._jdf.queryExecution().optimizedPlan().toString() for i, q in ((index, asked), (lone, lone.select(F.col("row").alias("query_id"), "embedding")))]
    assert "collect_list" in plan[0] and "collect_list" not in plan[1]


def test_rotation_retry(spark):
    rows = [(1, 0, 1, "a", 0, 0.5), (1, 1, 1, "b", 1, 0.7), (1, 2, 1, "c", 2, 0.7), (2, 0, 1, "a", 0, 0.65), (2, 1, 1, "b", 1, 0.9), (3, 1, 1, "b", 1, 0.2)]
    df = spark.createDataFrame(rows, "frame_id int, turn int, rank int, id string, row int, score double")
    assert sorted((r.frame_id, r.id) for r in search.best_rotation(df).collect()) == [(1, "b"), (2, "a"), (3, "b")]


def test_serial_chain(spark):
    printings = spark.createDataFrame(
        [("p1", "g", "Scratchmen Apoo", "OP17-070", "OP17", "normal", "2024"), ("p2", "g", "Scratchmen Apoo", "OP17-070", "PRB01", "foil", "2025"), ("p3", "g", "Nami", "OP12-070", "OP12", "normal", "2023")],
        "id string, game_id string, name string, number string, set_code string, variant string, release_date string",
    )
    reads = spark.createDataFrame([(1, "g", "OP12-070")], "scan_id int, game_id string, serial string")
    near = scan.near_printings(reads, printings)
    assert {r.id for r in near.collect()} == {"p1", "p2", "p3"}
    far = spark.createDataFrame([(1, "g", "OP28-070")], reads.schema)
    assert scan.near_printings(far, printings).count() == 0  # two digits off is not near
    reads = spark.createDataFrame([(1, "g", "OP18-070")], "scan_id int, game_id string, serial string")
    near = scan.near_printings(reads, printings).withColumn("lines", F.array(F.lit("SCRATCHMEN apoo"))).withColumn("image_score", F.lit(None).cast("double"))
    assert near.count() == 3
    chosen = scan.with_choice(near)
    got = scan.choose_serial(chosen).first()
    assert (got.serial, got.exact, got.name_score) == ("OP17-070", False, 1.0)
    ranked = scan.rank_by_serial(chosen)
    assert [r.id for r in ranked.orderBy("place").collect()] == ["p1", "p2"]  # the home set first
    out = scan.serial_results(ranked).first()
    assert out.printing_id == "p1" and out.confidence.tier == "check"


def test_chain_and_stale(spark):
    deltas = spark.createDataFrame([("g", "1", "2", 0), ("g", "2", "3", 1), ("h", "1", "2", 0)], "game string, `from` string, `to` string, ordinal int")
    wanted = spark.createDataFrame([("g", "1", "3"), ("h", "1", "3"), ("i", None, "3")], "game string, local string, target string")
    assert sorted((r.game, r.step, r.to) for r in publish.delta_chain(deltas, wanted).collect()) == [("g", 1, "2"), ("g", 2, "3")]
    steps = [("a", str(i), str(i + 1), 0) for i in range(80)] + [("b", "1", "2", 0), ("b", "2", "1", 0), ("b", "1", "3", 1)]
    deltas = spark.createDataFrame(steps, deltas.schema)
    wanted = spark.createDataFrame([("a", "0", "64"), ("a", "3", "68"), ("a", "79", "80"), ("a", "5", "5"), ("b", "2", "3"), ("b", "2", "9")], wanted.schema)
    rows = publish.delta_chain(deltas, wanted).collect()
    assert len(rows) == 64 + 1 + 2  # 65 links are too many; a cycle has no end
    assert sorted((r.step, r["from"], r.to) for r in rows if r.game == "b") == [(1, "2", "1"), (2, "1", "3")]
    versions = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 3, 1))], "game_id string, created_at timestamp")
    assert [r.game_id for r in publish.stale_games(versions, F.lit("2024-02-01").cast("timestamp")).collect()] == ["a"]
    progress = spark.createDataFrame([("c", None, dt.datetime(2024, 1, 1)), ("d", dt.datetime(2024, 1, 1), dt.datetime(2023, 1, 1))], "game_id string, done_at timestamp, updated_at timestamp")
    due = publish.due_game(progress, versions, F.lit("2024-02-01").cast("timestamp"))
    assert due.first().game_id == "c"
    keys = spark.createDataFrame([(f"games/g/index-{v}.bin", "20240930") for v in ("20240901", "20240925", "20241010")] + [("games/g/index-20240926.ids", "20240930")], "key string, at_most string")
    assert [tuple(r) for r in publish.newest_at_most(keys).collect()] == [("g", "20240925")]


def test_missing(spark):
    rows = spark.createDataFrame(list(enumerate("abcd")), "ordinal int, id string")
    have = spark.createDataFrame([("a",), ("c",)], "id string")
    assert [r.id for r in catalogue.select_missing(rows, have).collect()] == ["b", "d"]
    assert [r.id for r in catalogue.select_missing(rows, have, 1).collect()] == ["b"]


def test_collection_value(spark):
    rows = spark.createDataFrame([(1, 2, None, None, "2024", "a"), (1, 3, 2.0, "USD", "2023", "b"), (2, 1, None, None, "2024", "a")], "portfolio_id int, quantity long, market double, currency string, added_at string, printing_id string")
    got = {r.portfolio_id: (r.quantity, r.value, r.currency) for r in collection.collection_value(rows).collect()}
    assert got == {1: (5, 6.0, "USD"), 2: (1, 0.0, "GBP")}


def test_corrections_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p1", None)], "predicted string, corrected string, created_at string")
    for _ in range(2):
        collection.record_correction(rows, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2


def test_growing_an_index_keeps_what_was_done(spark, tmp_path):
    """A run that dies, a load that fails once, and printings that come later, all with one folder."""
    from tessera.operators.fingerprint import fingerprint_missing, forget

    printings = spark.createDataFrame([(i, c, c) for i, c in enumerate("abcdef")], "ordinal long, id string, address string")
    pack = spark.createDataFrame([(0, "c", [1.0])], "row long, id string, embedding array<double>")
    progress, tried = f"file://{tmp_path}/p", spark.sparkContext.accumulator(0)

    def embed(broken, dies):
        def batches(parts):
            for part in parts:
                for i in part["id"]:
                    tried.add(1)
                    if i == dies:
                        time.sleep(3)  # other tasks end before
                        raise RuntimeError("the run dies")
                    yield pd.DataFrame({"id": [i], "embedding": [[2.0]], "error": ["broken" if i == broken else None]})

        return lambda part: part.mapInPandas(batches, "id string, embedding array<double>, error string")

    with pytest.raises(Exception, match="the run dies"):
        fingerprint_missing(printings, pack, embed("b", "d"), progress, chunk=1)
    kept = {r.id for r in spark.read.parquet(progress).collect()}
    assert kept and kept <= {"a", "e", "f"}
    before = tried.value
    out, ids = fingerprint_missing(printings, pack, embed("b", None), progress, chunk=2)
    assert tried.value - before == 5 - len(kept)  # what was saved is not done again
    assert [r.id for r in out.orderBy("row").collect()] == ["c", "a", "d", "e", "f"] and sorted(r.id for r in ids.collect()) == ["a", "d", "e", "f"]
    more = printings.union(spark.createDataFrame([(6, "g", "g"), (7, "h", "h")], printings.schema))
    out, ids = fingerprint_missing(more, pack, embed(None, None), progress)
    assert [r.id for r in out.orderBy("row").collect()] == ["c", *"abdefgh"] and ids.count() == 7
    out, ids = fingerprint_missing(more, written(out, "pack"), embed("x", "x"), progress)
    assert out.count() == 8 and ids.count() == 0
    forget(more, progress)
    same, none = fingerprint_missing(printings.where("id = 'c'"), pack, embed("x", "x"), progress)
    assert same is pack and none.count() == 0


def test_comparing_snapshots(spark):
    kind = "id string, game_id string, x string, y string, at int"
    old = spark.createDataFrame([("a", "g", None, "v", 1), ("b", "g", "1", "2", 1), ("c", "g", "1", "2", 1), ("d", "g", "1", "2", 1), ("d", "h", "1", "2", 1)], kind)
    new = spark.createDataFrame([("a", "g", "v", None, 1), ("b", "g", "1", "2", 2), ("c", "g", "1", "3", 1), ("d", "h", "1", "2", 1), ("e", "h", None, None, None)], kind)
    got = {(r.id, r.game_id, r.change, r.y) for r in changes.compare(old, new, ["id", "game_id"], ["at"]).collect()}
    assert got == {("a", "g", "changed", None), ("c", "g", "changed", "3"), ("d", "g", "removed", None), ("e", "h", "added", None)}
    assert changes.compare(old, old, ["id", "game_id"]).count() == 0
    assert {r.change for r in changes.compare(old, new.limit(0), ["id", "game_id"]).collect()} == {"removed"}


def test_plan_of_a_sync(spark):
    deltas = [("3", "4"), ("2", "3"), ("1", "2")]
    manifest = spark.createDataFrame([(g, "4", [{"from": a, "to": b} for a, b in deltas]) for g in "abcdef"], "game string, version string, deltas array<struct<`from`: string, to: string>>")
    local = spark.createDataFrame([("a", "2"), ("b", "4"), ("c", "0"), ("d", "1"), ("e", None)], "game string, version string")
    stored = spark.createDataFrame([(g, a, b) for g in "abcdef" for a, b in deltas if (g, a) != ("d", "2")], "game string, `from` string, to string")
    plan = lambda *x: sorted((tuple(r) for r in changes.plan_sync(manifest, local, *x).collect()), key=str)
    full = [(g, 1, None, "4") for g in "cef"]
    assert plan(stored) == sorted([("a", 1, "2", "3"), ("a", 2, "3", "4"), ("d", 1, None, "4"), *full], key=str)
    assert plan() == sorted([("a", 1, "2", "3"), ("a", 2, "3", "4"), ("d", 1, "1", "2"), ("d", 2, "2", "3"), ("d", 3, "3", "4"), *full], key=str)


def test_changes_of_many_steps_at_once(spark):
    """As the same steps one by one: removed and added again, removed last, changed twice, first values kept."""
    base = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x")], "id string, first string, last string")
    steps = [([("a", "2", "y"), ("e", "2", "y")], ["b"]), ([("b", "3", "z"), ("a", "3", "z"), ("f", "3", "z")], ["c", "f"]), ([("b", "4", "w")], ["e"])]
    put = spark.createDataFrame([(*r, i, 0) for i, (rows, _) in enumerate(steps) for r in rows], "id string, first string, last string, step int, seq int")
    gone = spark.createDataFrame([(i, n) for n, (_, ids) in enumerate(steps) for i in ids], "id string, step int")
    want = base
    for n in range(3):
        want = merge.merge_lww(want, put.where(F.col("step") == n).drop("step"), ["id"], "seq", ["last"])
        want = merge.delete_keys(want, gone.where(F.col("step") == n), ["id"])
    got = changes.apply_changes(base, put, gone, ["id"], ["last"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("a", "1", "z"), ("b", "3", "w"), ("d", "1", "x")]


def test_documents_are_read_by_ranges(spark, tmp_path):
    """Two documents, of more bytes than a task reads, with marks of JSON in their values; other layouts give no rows."""
    values = ['a "quoted" ]', ',"sets":[', "line\nend", "é"]
    rows = {g: spark.range(400).select(F.lit(g).alias("game"), F.concat(F.lit(g), F.col("id").cast("string")).alias("id"), F.lit(g).alias("gameId"), F.element_at(F.array(*map(F.lit, values)), (F.col("id") % 4 + 1).cast("int")).alias("name"), F.lit(None).cast("string").alias("artId")) for g in "gh"}
    gone = spark.createDataFrame([("g", 'x"1'), ("h", "y")], "game string, id string")
    lost = spark.createDataFrame([("h", "p", "s")], "game string, printing_id string, source string")
    heads = spark.createDataFrame([(g, f, "2", f"file://{tmp_path}/{g}.json") for g, f in (("g", None), ("h", "1"))], "game string, `from` string, to string, path string")
    paths = publish.write_documents({"cards": rows["g"].union(rows["h"]), "removedPrintings": gone, "removedPrices": lost}, heads)
    assert [p[-6:] for p in paths] == ["g.json", "h.json"]
    for g, f in (("g", None), ("h", "1")):
        whole = json.loads((tmp_path / f"{g}.json").read_text())
        assert (whole["game"], whole["from"], whole["to"]) == (g, f, "2") and len(whole["cards"]) == 400 and whole["sets"] == []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = publish.read_documents(spark, paths)
        assert sorted((r.doc, r.id, r.name) for r in read["cards"].collect()) == sorted(("gh".index(g), f"{g}{i}", values[i % 4]) for g in "gh" for i in range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, read["removedPrintings"].select("id", "doc").collect())) == [('x"1', 0), ("y", 1)]
    assert [tuple(r) for r in read["removedPrices"].collect()] == [("p", "s", 1)] and read["printings"].count() == 0
    assert publish.write_documents({}, heads.limit(0)) == []


def test_books(spark):
    from tessera.operators import refresh

    versions = spark.createDataFrame([("g", "1", 5, None, "2024")], "game_id string, version string, printings_count long, index_pack_key string, created_at string")
    again = versions.withColumn("printings_count", F.lit(7).cast("long")).withColumn("created_at", F.lit("2025")).withColumn("seq", F.lit(0))
    assert tuple(refresh.record_versions(versions, again).first()) == ("g", "1", 7, None, "2024")
    assert refresh.attach_index(versions, "g", "1", "k").first().index_pack_key == "k"
    runs = spark.createDataFrame([(1, "a", None, "running", None), (2, "b", None, "running", None)], "id int, started_at string, finished_at string, status string, detail string")
    ended = spark.createDataFrame([(1, "z", "ok", "d")], "id int, finished_at string, status string, detail string")
    assert sorted(map(tuple, refresh.close_runs(runs, ended).collect())) == [(1, "a", "z", "ok", "d"), (2, "b", None, "running", None)]
    held = spark.createDataFrame([("g", "1", 5)], "game_id string, version string, n long")
    assert tuple(refresh.set_client_versions(held, spark.createDataFrame([("g", "2", 6, 0)], "game_id string, version string, n long, seq int")).first()) == ("g", "2", 6)


def test_sync_by_chain_or_full_pack(spark):
    base = {"cards": spark.createDataFrame([("a", "A", "x")], "id string, name string, art_id string")}
    deltas = [{"cards": spark.createDataFrame([("a", n, "y", 0), (n, n, "z", 1)], "id string, name string, art_id string, seq int")} for n in ("B", "C")]
    assert sorted(map(tuple, publish.sync(base, deltas)["cards"].collect())) == [("B", "B", "z"), ("C", "C", "z"), ("a", "C", "y")]
    assert publish.sync(base, [], deltas[0])["cards"].count() == 2 and publish.sync(base, []) is base
    rows = spark.createDataFrame([(None, None)], "variant string, updated_at string")
    assert tuple(publish.with_defaults(rows, F.lit("now")).first()) == ("normal", "now")


def test_other_candidates_and_readings(spark):
    expanded = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x")], "scan_id long, art_rank int, art_id string")
    printings = spark.createDataFrame([(1, 1, "x", "a"), (1, 2, "y", "b"), (1, 3, "y", "c"), (2, 1, "x", "a")], "scan_id long, ordinal int, art_id string, id string")
    named = spark.createDataFrame([(1, "c")], "scan_id long, id string")
    assert sorted((r.scan_id, r.art_id) for r in scan.other_candidates(expanded, printings, named).collect()) == [(1, "x"), (2, "x")]
    chosen = spark.createDataFrame([(1, "a"), (2, "z")], "scan_id long, printing_id string")
    assert sorted((r.scan_id, r.place, r.id) for r in scan.alternatives(printings, chosen, 1).collect()) == [(1, 1, "b"), (2, 1, "a")]
    readings = spark.createDataFrame([(1, 2, ["OP01-002"]), (1, 1, ["x", "OP01-001"]), (1, 0, ["none"]), (2, 0, [])], "frame_id long, turn int, lines array<string>")
    assert [tuple(r) for r in scan.first_reading(readings).collect()] == [(1, "OP01-001", ["x", "OP01-001"], 1)]


def test_names_in_texts_against_every_pair(spark):
    from tessera.functions import reading as R

    lines = [["SCRATCHMEN  apoo", "x"], ["men Apoo"], ["Scratchrnen Apoo"], ["Apco"], [], [""], ["monkey d lufly and namı"]]
    texts = spark.createDataFrame(list(enumerate(lines)), "k long, lines array<string>")
    names = spark.createDataFrame([("Scratchmen Apoo",), ("Monkey D Luffy",), ("Nami",), ("to be",), ("Apoo Apoo Monkeys",)], "name string")
    want = texts.crossJoin(names).select("k", "name", R.name_similarity(F.col("lines"), F.col("name")).alias("s")).where("s > 0").collect()
    got = scan.named_in(texts, names, "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 4


def test_frames_are_turned_where_they_are_weak(spark):
    from tessera.functions import image as I
    from tessera.operators import frames
    from tessera.plans.queries import block_means

    rng = np.random.default_rng(3)
    cards = [np.concatenate([np.kron(rng.integers(0, 256, (4, 4, 3)), np.ones((8, 8, 1))), np.full((32, 32, 1), 255)], axis=2).astype(np.uint8) for _ in range(4)]
    quad = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    shots = [cards[0], cards[1][::-1, ::-1], np.rot90(cards[2], 1), cards[3], cards[3]]
    rows = [(i, (*I.packed(a),), quad if i != 4 else [0.0] * 8, 0.0, 0.01 if i == 3 else 0.5) for i, a in enumerate(shots)]
    asked = spark.createDataFrame(rows, f"frame_id long, image struct<{I.IMAGE}>, raw array<double>, presence double, sharpness double")
    known = spark.createDataFrame([(i, str(i), (*I.packed(a),)) for i, a in enumerate(cards)], f"row long, id string, image struct<{I.IMAGE}>")
    index = known.select("row", "id", block_means(F.col("image")).alias("embedding"))
    seen, found = frames.process_frames(asked, index, block_means, k=2, size=32, retry_below=0.9)
    assert {r.frame_id: r.rejected for r in seen.collect()} == {0: None, 1: None, 2: None, 3: "no-card", 4: "bad-quad"}
    assert sorted((r.frame_id, r.turn, r.id) for r in found.where("rank = 1").collect()) == [(0, 0, "0"), (1, 180, "1"), (2, 90, "2")]


def test_serials_are_read_in_the_first_orientation_that_has_one(spark):
    """A recogniser that sees a serial where the strip is red: the top of the card, which lies to the right."""
    from tessera.functions import image as I
    from tessera.operators import frames

    a = np.zeros((80, 60, 4), dtype=np.uint8)
    a[:, :9, 0] = 255  # the strip at the card's foot, whose foot is the frame's left side

    @F.pandas_udf("array<string>")
    def recognise(strips: pd.DataFrame) -> pd.Series:
        reds = [I.pixels(d, w, h)[..., 0].mean() for d, w, h in strips[["data", "width", "height"]].itertuples(index=False)]
        return pd.Series([["OP01-001"] if r > 200 else ["nothing"] for r in reds])

    square = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    rows = [(1, (*I.packed(a),), (square,)), (2, (*I.packed(a * 0),), (square,))]
    frame = spark.createDataFrame(rows, f"frame_id long, image struct<{I.IMAGE}>, detection struct<corners:array<struct<x:double,y:double>>>")
    assert [(r.frame_id, r.serial, r.turn) for r in frames.read_serials(frame, "onepiece", recognise, width=90).collect()] == [(1, "OP01-001", 1)]
