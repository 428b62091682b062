"""What must not pass through the driver, and what must not be cut."""

import random

import numpy as np
import pytest

from tessera.llm import simhash, toxicity
from tessera.llm.common import written


def test_the_signature_index_is_not_broadcast(spark):
    """Its rows are 64 times those of its files, so Spark's estimate would send it through the driver."""
    rows = written(spark.createDataFrame([(x,) for x in (0, 1, 3, -1, -2)], "fp long"), "test")
    links = simhash.links(rows)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    pairs = {(0, 1), (0, 3), (1, 3), (-2, -1)}
    assert {(r.a, r.b) for r in links.collect()} == pairs


def test_words_beyond_the_model_count_as_those_in_it(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words[: 40 if i % 5 else 80]) for _ in range(rng.randint(1, 30))) + (" zzzq qwzxj" if i % 5 == 0 else "")) for i in range(600)]
    rows += [(600, ""), (601, None), (602, words[3]), (603, words[3] + " " + words[3]), (604, "neverseen")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    whole, few = (toxicity.fit(frame, labels, per_class=16, most_words=n) for n in (1_000, 10))
    assert whole.rest is None and len(few.keys) <= 10 and len(few.keys) + few.rest.count() == len(whole.keys)
    for r in toxicity.features(few, frame, "x").collect():
        assert r.x == pytest.approx(whole.evidence(r.text), abs=1e-5)
    assert np.allclose(few.curve, whole.curve, atol=1e-3)
    a, b = ({r.doc_id: r.score for r in toxicity.classify(frame, labels, 16, n).collect()} for n in (1_000, 10))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-4) for i in a)


def test_links_that_no_leader_has_are_compared(spark):
    """A text has one link, to a text that is no leader it takes: its cluster is its own, but they share a key."""
    prints = {0: [0b111], 1: [0b110], 2: [-1], 3: [0b101], 4: [0b011]}
    classes = spark.createDataFrame([(c, f * 8, 100) for c, f in prints.items()], "cid long, fps array<long>, size long")
    shared = spark.createDataFrame([(c, f[0], k) for c, f in prints.items() for k in (5, 6)], "cid long, f0 long, k long")
    rows = spark.createDataFrame([(0, 0), (1, 0), (3, 0), (2, 2), (4, 4)], "cid long, cluster long")
    got = sorted((r.a, r.b) for r in simhash.across(shared, rows, classes, 22).collect())
    assert got == [(0, 4), (1, 4), (3, 4)]  # 2 is near none, and what is of one cluster is compared there


def test_no_bound_on_leaders_loses_a_link(spark, monkeypatch):
    """With no leaders at all, what shares a key is still compared."""
    rng = random.Random(3)
    bases = [[f"w{rng.randrange(100_000)}" for _ in range(150)] for _ in range(40)]
    texts = [" ".join(b) for b in bases] + [" ".join(b[:-3]) for b in bases]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "near_leaders", lambda shared, known, near, turn: spark.createDataFrame([], "a long, b long, d long"))
    assert sorted(r.doc_id for r in simhash.keep_representatives(docs).collect()) == list(range(40))
