import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import packing, quality, queries, secret_scan, toxicity
from tessera.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shingles(text):
    """Of A-Z in lower case; five words between ASCII spaces, or all of a shorter text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_by_brute_force(rows):
    """Ids of the first document of each group that a similarity of 0.8 or more links, by all pairs of sets."""
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        first.setdefault(shingles(text), i)
    sets = sorted(first, key=len)
    low = {s: first[s] for s in sets}
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[k + 1 :]:
            if 4 * len(b) > 5 * len(a):
                break
            if 5 * len(a & b) >= 4 * len(a | b) and a | b:
                x, y = find(a), find(b)
                if x is not y:
                    lo, hi = (x, y) if low[x] < low[y] else (y, x)
                    root[hi] = lo
    return {low[s] for s in sets if root[s] is s}


def test_stages_are_the_operators_on_what_came_before(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = docs
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:4], (lambda d: quality.keep_good(d, labels), lambda d: toxicity.keep_ordinary(d, labels), None, secret_scan.redact_secrets), strict=True):
        before, rows = rows, stage(spark, rows, SF).cache()
        assert rows.columns == docs.columns
        if plain:
            assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain(before).collect()))
        else:
            kept = sorted(r.doc_id for r in rows.collect())
            assert kept == sorted(kept_by_brute_force([(r.doc_id, r.text) for r in before.collect()])) and len(kept) < before.count()
    last = corpus_pipeline.STAGES[4][1](spark, rows, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in rows.collect()}
    assert sum(r.length for r in last if r.piece == 0) > 0 and packing.CAPACITY == 2048
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in ran) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last)


def test_stages_on_odd_rows(spark):
    """Null and empty texts, null and repeated ids, columns with the operators' own names, and no rows at all."""
    long = " ".join(f"word{i}" for i in range(3_000))
    rows = [(None, None), (1, None), (2, ""), (3, "short text"), (3, "short text"), (4, long), (5, long + " token = abcdefgh")]
    frame = spark.createDataFrame([(i, t, "x", 1, "en") for i, t in rows], "doc_id long, text string, score string, fps int, cid string")
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            n = out.count()
            assert n == docs.count() if name == "secret scan" else n <= docs.count()
        packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
        assert len(packed) >= docs.count()
    near = corpus_pipeline.STAGES[2][1](spark, frame, SF)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "3", "4"]
    assert near.where("doc_id = 4").select(F.length("text")).first()[0] == len(long)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_return_a_row_for_each_input(spark, name):
    rows = queries.queries()[name](spark, SF)
    source = {"op7": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
    n, want = rows.count(), table(spark, SF, source).count()
    if name.startswith("op12"):  # every part, order and step
        want = 600 * table(spark, SF, source).select("source").distinct().count()
    assert n == want if not name.startswith("op5") else n >= want
