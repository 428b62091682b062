import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import image as I
from tessera.functions import reading as R
from tessera.functions import text as T
from tessera.functions import vector as V

col = F.col


def values(spark, rows, schema, expr):
    """expr over rows, in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select(expr.alias("x"), "i").orderBy("i").collect()]


def of_strings(spark, inputs, f):
    return values(spark, [(x,) for x in inputs], "s string", f(col("s")))


CASES = [
    (T.normalise_number, {"025": "25", "OP07-119": "OP07119", "0": "0", "000": "0", "-": "", None: None}),
    (T.normalise_name, {"Pokémon: Charizard ex": "pokemon charizard ex", "Monkey.D.Luffy": "monkey d luffy", "ﬁne": "fine", None: None}),
    (T.normalise_set_code, {"SV-1": "SV1", "op 07": "OP07"}),
    (T.variant_of, {"Charizard": "normal", "Pikachu (Reverse Holo)": "reverse", "Pikachu (Holo)": "foil", "Pikachu (1st Edition)": "first_edition", "Reverse": "normal"}),
    (T.parse_money, {"1.5": 1.5, "2.25": 2.25, "": None, None: None, "n/a": None, "-1": None, "3abc": 3.0, "Infinity": None, "1e400": None}),
    (R.serial_set, {"OP17-070": "OP17", "P-001": "P"}),
    (T.labelled_printing, {"a/onepiece:OP07:119:normal:en__glare.jpg": "onepiece:OP07:119:normal:en", "x.jpg": "x", "x.png": None}),
    (T.is_mutable_pack, {"/packs/games/x/index-2024.bin": True, "/packs/games/x/catalog-2024.json": False}),
]


@pytest.mark.parametrize(("f", "cases"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_scalar_tables(spark, f, cases):
    assert of_strings(spark, list(cases), f) == list(cases.values())


def test_split_number(spark):
    got = of_strings(spark, ["025/198", "OP07-119", " 25 / 198 ", "\t25\u00a0/\n198\r\n", "\tOP07-119\u3000\n"], T.split_number)
    assert [tuple(x) for x in got] == [("025", "198"), ("OP07-119", None), ("25", "198"), ("25", "198"), ("OP07-119", None)]


def test_keys(spark):
    ids = values(spark, [("SV1", "025"), ("SV-1", "25")], "c string, n string", T.printing_id(F.lit("pokemon"), col("c"), col("n"), F.lit("normal")))
    assert ids[0] == ids[1] == "pokemon:SV1:25:normal:en"
    keys = values(spark, [("OP-07", "119", "Monkey D. Luffy"), ("op07", "0119", "Monkey D Luffy")], "c string, n string, m string", T.match_key(col("c"), col("n"), col("m")))
    assert keys[0] == keys[1]


def test_urls(spark):
    got = values(spark, [("http://x/a", 'W/"1 2"'), ("http://x/a?b=1", "e"), ("http://x/a", None), ("http://x/a", "")], "u string, e string", T.with_version_param(col("u"), col("e")))
    assert got == ["http://x/a?e=W%2F%221%202%22", "http://x/a?b=1&e=e", "http://x/a", "http://x/a"]
    stale = values(spark, [("a", None), ("a", "a"), ("a", "b"), (None, "b")], "a string, b string", T.is_index_stale(col("a"), col("b")))
    assert stale == [False, False, True, True]


def test_numbers_match(spark):
    rows = [("025", "25"), ("OP07-119", "op07119"), (None, "1"), ("025", "250"), ("", "")]
    assert values(spark, rows, "a string, b string", T.numbers_match(col("a"), col("b"))) == [True, True, False, False, False]


SERIALS = [
    (["OP17-070"], "OP17-070"), (["OP17 - 070"], "OP17-070"), (["OP17–070"], "OP17-070"), (["op17-070"], "OP17-070"), (["0P17-070"], "OP17-070"),
    (["OP17-O70"], "OP17-070"), (["OP1 7-07O"], "OP17-070"), (["OP17070"], "OP17-070"), (["P-001"], "P-001"), (["STRIKE 1000"], None),
    (["OPPONENT 2020"], None), ([], None), (["nothing here", "OP15-113", "OP17-070"], "OP15-113"),
]


def test_serials(spark):
    assert values(spark, [(x,) for x, _ in SERIALS], "s array<string>", R.parse_serial(col("s"))) == [y for _, y in SERIALS]


def test_only_one_game_prints_serials(spark):
    rows = [("onepiece", ["OP17-070"]), ("mtg", ["OP17-070"])]
    assert values(spark, rows, "g string, l array<string>", R.serial_for_game(col("g"), col("l"))) == ["OP17-070", None]


def test_near_patterns(spark):
    got = of_strings(spark, ["OP12-070", "P-001"], R.near_serial_patterns)
    assert got == [["OP12-070", "OP_2-070", "OP1_-070", "OP12-_70", "OP12-0_0", "OP12-07_"], ["P-001", "P-_01", "P-0_1", "P-00_"]]


def test_name_similarity(spark):
    rows = [(["SCRATCHMEN  apoo", "x"], "Scratchmen Apoo"), (["men Apoo"], "Scratchmen Apoo"), (["Scratchrnen Apoo"], "Scratchmen Apoo"), (["Apco"], "Apoo"), (["to be"], "to be"), ([], "Apoo")]
    got = values(spark, rows, "l array<string>, n string", R.name_similarity(col("l"), col("n")))
    assert got == [1.0, 0.5, 1.0, 0.0, 0.0, 0.0]


def within(text, word, k):
    """Approximate substring by the classic dynamic programme."""
    row = list(range(len(word) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, w in enumerate(word):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != w)))
        row = new
        best = min(best, row[-1])
    return best <= k


def test_contains_approximately_against_the_dynamic_programme(spark):
    import random

    rng = random.Random(5)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 8))), rng.randint(0, 2)) for _ in range(400)]
    got = values(spark, rows, "h string, n string, k int", R.contains_approximately(col("h"), col("n"), col("k")))
    assert got == [within(*r) for r in rows]


def test_corners(spark):
    lines = [["OP07-119", "SR"], ["025/198"], ["25 / 198"], ["日本語"], ["..."], ["LOB-EN001"]]
    got = values(spark, [(x,) for x in lines], "l array<string>", R.parse_corner(col("l")))
    assert [tuple(x) for x in got] == [("OP07", "119", None, None), (None, "025", "198", None), (None, "25", "198", None), (None, None, None, "ja"), (None, None, None, None), ("LOB", "001", None, "en")]


def test_confidence_tiers(spark):
    rows = [(0.94, 0.61, 3, True), (0.72, 0.71, 3, None), (0.86, 0.80, 3, None), (0.42, None, 1, None), (None, None, 0, None)]
    got = values(spark, rows, "a double, b double, n int, o boolean", V.picture_confidence(col("a"), col("b"), col("n"), col("o"), F.lit(None).cast("double")))
    assert [x["tier"] for x in got] == ["high", "low", "check", "low", "low"]
    assert got[4]["score"] == 0.0 and got[4]["reasons"] == ["no candidates"] and "weak match" in got[3]["reasons"]


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0])]
    assert values(spark, rows, "a array<double>, b array<double>", V.l2_normalise(col("a"))) == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, rows, "a array<double>, b array<double>", V.dot(col("a"), col("b"))) == [3.0, None]
    assert values(spark, [(2.0,), (-1.0,), (float("nan"),), (None,)], "x double", V.clamp01(col("x"))) == [1.0, 0.0, 0.0, 0.0]
    a, b = [100.0] * 4, [160.0] * 4
    assert values(spark, [(a, b)], "a array<double>, b array<double>", V.scene_distance(col("a"), col("b"))) == [0.0]


def quad(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE = quad((0, 0), (1, 0), (1, 1), (0, 1))


def test_quads(spark):
    bad = [quad((0, 0), (1, 0), (0.2, 0.2), (0, 1)), quad((0, 0), (0, 0), (1, 1), (0, 1)), quad((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01))]
    rows = [(SQUARE,), *[(q,) for q in bad], (None,)]
    assert values(spark, rows, f"q {G.QUAD}", G.usable_quad(col("q"))) == [True, False, False, False, False]
    assert values(spark, rows[:1], f"q {G.QUAD}", G.quad_area(col("q"))) == [1.0]
    mixed = [SQUARE[i] for i in (2, 0, 3, 1)]
    got = values(spark, [(mixed,)], f"q {G.QUAD}", G.ordered_corners(col("q")))[0]
    assert [(p["x"], p["y"]) for p in got] == [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_corners_start_with_the_shortest_edge(spark):
    """A card that lies on its side: the left edge is the top one."""
    side = quad((0.1, 0.3), (0.9, 0.3), (0.9, 0.7), (0.1, 0.7))
    rows = [([side[i] for i in order], w, h) for order in ((0, 1, 2, 3), (2, 0, 3, 1)) for w, h in ((100, 100), (100, 300))]
    got = values(spark, rows, f"q {G.QUAD}, w int, h int", G.ordered_corners(col("q"), col("w"), col("h")))
    points = [[(p["x"], p["y"]) for p in g] for g in got]
    corners = [(p["x"], p["y"]) for p in side]
    assert points == [corners[1:] + corners[:1], corners] * 2  # of equal edges the first: right before left
    raw = [1.9, 0.3, float("nan"), 0.3, 0.1, 0.7, 0.9, 0.7]
    d = values(spark, [(raw, 0.0, None), (raw, 5.0, 0.02), ([0.5] * 8, 5.0, 0.5)], "r array<double>, p double, s double", G.detection(col("r"), col("p"), col("s"), F.lit(640), F.lit(480)))
    assert [(round(x["confidence"], 3), x["card_present"]) for x in d] == [(0.5, True), (0.02, False), (0.5, True)]
    assert {(p["x"], p["y"]) for p in d[0]["corners"]} == {(1.0, 0.3), (0.0, 0.3), (0.1, 0.7), (0.9, 0.7)}


def test_small_functions(spark):
    assert of_strings(spark, ["2024-07-01 10:00:00"], lambda s: T.next_version(s.cast("timestamp"))) == ["20240701"]
    assert of_strings(spark, ["aGVs\n bG8="], lambda s: T.decoded_base64(s).cast("string")) == ["hello"]
    assert of_strings(spark, ["2024-07-01T10:00:00Z"], T.day_of) == ["2024-07-01"]
    rows = [(False, None, None), (True, "a", "a"), (True, "a", "b"), (True, "a", None)]
    assert values(spark, rows, "h boolean, s string, r string", T.index_needs_download(col("h"), col("s"), col("r"))) == [True, False, True, False]
    assert values(spark, [([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>", V.mean_abs_diff(col("a"), col("b"))) == [1.5]
    rows = [(0, None, "a"), (2, "a", None), (2, "a", "a"), (2, "a", "b")]
    assert values(spark, rows, "n int, f string, c string", V.ocr_agreement(col("n"), col("f"), col("c"))) == [None, False, True, False]


def test_homography(spark):
    to = quad((10, 20), (30, 22), (28, 50), (12, 44))
    h = G.homography(col("a"), col("b"))
    out = G.apply_homography(h, F.lit(1.0), F.lit(1.0))
    got = values(spark, [(SQUARE, to), (SQUARE, quad((0, 0), (0, 0), (0, 0), (0, 0)))], f"a {G.QUAD}, b {G.QUAD}", out)
    assert got[0]["x"] == pytest.approx(28) and got[0]["y"] == pytest.approx(50)
    degenerate = quad((0, 0), (0, 0), (0, 0), (0, 0))
    assert values(spark, [(degenerate, SQUARE)], f"a {G.QUAD}, b {G.QUAD}", h) == [None]


def test_pictures_of_one_size_are_worked_on_together():
    """a stack of pictures gives what each of them gives alone, to the last bit."""
    rng = np.random.default_rng(5)
    for h, w in ((9, 7), (2, 3), (64, 40)):
        a = rng.integers(0, 256, (5, h, w, 4)).astype(np.uint8)
        for f in (lambda a: I.resample(a, 32, 32), lambda a: I.resample(a, 5, 4), lambda a: I.squash(a, 16), lambda a: I.shrink(a, 5), lambda a: I.crop(a, 0.1, 0.2, 0.5, 0.5), I.argb, I.tensor):
            assert all(np.array_equal(x, f(y)) for x, y in zip(f(a), a, strict=True))


def test_pictures_are_dealt_to_several_tasks(spark):
    """a table of few bytes is one split of its file, and its pictures were one task's work."""
    from tessera.plans.queries import pictures

    spark.createDataFrame([(k, k % 50 + 1) for k in range(200)], "p_partkey long, p_size int").coalesce(1).write.mode("overwrite").parquet(f"{(d := tempfile.mkdtemp(dir='/tmp'))}/part.parquet")
    rows = pictures(spark, d).withColumn("task", F.spark_partition_id()).select("task", I.sinc_resize(F.col("image"), 32, 32).alias("image"), I.tensor_sum(F.col("image")).alias("total"), I.to_tensor(F.col("image")).alias("all"))
    got = rows.collect()
    assert len(got) == 200 and len({r.task for r in got}) > 1
    assert all(r.total == sum(r["all"], 0.0) and len(r.image.data) == 32 * 32 * 4 for r in got)


def test_dewarp_of_many(spark):
    """degenerate quads and null ones give null beside others of the same size."""
    rng = np.random.default_rng(6)
    quad = [(0.1, 0.1), (0.9, 0.2), (0.8, 0.9), (0.0, 1.0)]
    images = [I.packed(rng.integers(0, 256, (8, 6 + i % 2, 4))) for i in range(6)]
    quads = [quad, None, [quad[0]] * 4, quad[:3], quad, quad]
    df = spark.createDataFrame([(i, m, q) for i, (m, q) in enumerate(zip(images, quads, strict=True))], "id int, image struct<data:binary,width:int,height:int>, quad array<struct<x:double,y:double>>")
    got = {r.id: r.flat for r in df.select("id", I.dewarp(F.col("image"), F.col("quad"), 8).alias("flat")).collect()}
    assert [i for i, m in got.items() if m is None or m.data is None] == [1, 2, 3]
    for i in (0, 4, 5):
        alone = I.flatten(I.pixels(*images[i]), [{"x": x, "y": y} for x, y in quad], 8)
        assert bytes(got[i].data) == alone.tobytes()
