"""Benchmark decontamination against all windows of all texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def wanted(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in range(1, 11):
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(short):
    rng = random.Random(5)
    vocabulary = ["the", "a", "x", "é", "ñandú", "b2", "日本", *(f"w{i}" for i in range(30))]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(10, 40)))) for i in range(20)]
    items += [(20, items[3][1]), (21, items[3][1]), (4, items[4][1].upper()), (22, None), (23, " ,.; "), (None, " ".join(text(12)))]
    if short:
        items += [(30, "one"), (31, "only, Two"), (32, "a short item of six words"), (33, "nine words in a row make this item short")]
    docs = []
    for i in range(150):
        body = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            own = words(rng.choice(items)[1])
            s = rng.randint(0, max(0, len(own) - 1))
            own = own[s : s + rng.randint(1, 30)]
            at = rng.randint(0, len(body))
            body[at:at] = [x.capitalize() for x in own]
        docs.append((i, rng.choice([" ", ", ", "\n", "-"]).join(body)))
    docs += [(200, None), (201, ""), (202, "..."), (7, docs[7][1]), (None, items[0][1]), (203, items[0][1] + " " + items[0][1]), (204, " ".join(text(20_000)) + " " + items[5][1])]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("most", [0, decontamination.BROADCAST_ROWS])
def test_against_all_windows(spark, monkeypatch, short, most):
    """With short items and without; with broadcasts and with none."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    docs, items = made(short)
    frame = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n_words int, tid string").repartition(3)
    bench = spark.createDataFrame([(i, t, "h") for i, t in items], "item_id long, text string, window string")
    got = decontamination.contamination(frame, bench)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(docs, items)


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontamination.contamination(frame, bench).collect()] == [(3, 0, 0)]
    full = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert decontamination.contamination(frame.limit(0), full).count() == 0


def test_only_functions_of_spark_run(spark):
    docs, items = made(True)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    w = bench.select(decontamination.text_words(F.col("text")).alias("w"))
    kept = w.select(F.explode(decontamination.all_fingerprints(F.col("w"), decontamination.levels(w))).alias("f")).select("f.h").distinct()
    texts = frame.select(F.unhex(F.md5("text")).alias("tid"), decontamination.text_words(F.col("text")).alias("w"))
    plan = decontamination.hits(texts, kept, decontamination.levels(w))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "pandas" not in plan.lower()


def test_winnowing_keeps_the_least_of_each_neighbourhood(spark):
    frame = spark.createDataFrame([(" ".join(f"w{i * i % 13}" for i in range(40)),)], "text string")
    w = decontamination.text_words(F.col("text"))
    kept = {(r.p, r.h) for r in frame.select(F.explode(decontamination.fingerprints(w, 10, 5)).alias("f")).select("f.*").collect()}
    every = {r.p: r.h for r in frame.select(F.explode(decontamination.fingerprints(w, 5, 5)).alias("f")).select("f.*").collect()}
    assert len(every) == 36 and len(kept) < len(every)
    places = {p for p, _ in kept}
    for s in range(len(every) - 5):  # other seeds hash alike, so compare places by order of the kept ones
        assert places & set(range(s, s + 6))


def test_values_of_hot_and_missing_keys(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([None] * 50 + ["h"] * 50 + list("abc"))], "k string, i int")
    values = spark.createDataFrame([("h", 1), ("a", 2), ("z", 3), (None, 9)], "k string, v int")
    got = common.with_values(rows, values, ["k"])
    assert sorted((r.k or "", r.v) for r in got.where("v IS NOT NULL").collect()) == [("a", 2)] + [("h", 1)] * 50 and got.count() == 103
