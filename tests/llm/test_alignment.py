"""Cross-tokenizer alignment against whole texts, offsets and plain counts."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "The cat sat on the mat.", "The cat sat on the mat.", "  two  spaces ", "a\n\n b\nc", "a\r\nb;\r\n c();\r\n", "x　y \xa0z  w",
    "<|endoftext|> plain </s> <s> <0x0A>", "a▁b", "\n\nfirst", "a\x1c b!\x1d c", "é" * 40, "aaaa" * 500, "\t\tx  \n y", "it's  ok\n  'll", "🙂🙂 👩‍👩‍👧 ñandú", "0123456789 " * 30, "the the the the",
]


def plain(aligner, text):
    """Tokens of the whole text, cut where both end."""
    if not text:
        return []
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    a_bytes, b_bytes = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []
    a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        i2, j2 = a_ends.index(cut) + 1, b_ends.index(cut) + 1
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return groups


def wanted(texts):
    aligner = alignment.Aligner(A, B)
    each = [plain(aligner, t) for t in texts]
    links = [Counter((p, q) for a, b in g for p in a for q in b) for g in each]
    count = Counter(pair for ls in links for pair in ls)
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for g, ls in zip(each, links, strict=True):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), ls.total(), sum(m for x, m in ls.items() if count[x] == most[x[0]]),
            sum(m * count[x] for x, m in ls.items()), hashlib.sha256(told.encode()).hexdigest() if g else "",
        ))
    return out


@pytest.mark.parametrize("hot_pairs", [1, 5, alignment.HOT_PAIRS])
def test_against_whole_texts(spark, hot_pairs):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = alignment.alignments(docs, A, B, hot_pairs=hot_pairs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == wanted(TEXTS)
    assert got[4][1:] == got[5][1:] and got[4].n_links > 0 and got[11].groups_sha256 == ""


def test_units_give_the_tokens_of_whole_texts(monkeypatch):
    cut = alignment.Aligner(A, B)
    whole = alignment.Aligner(A, B)
    assert cut.by_units
    whole.by_units = False
    plainly = lambda found: [(*x[:5], x[5].tolist(), x[6].tolist()) for x in found]
    want = plainly(whole.aligned(TEXTS))
    assert plainly(cut.aligned(TEXTS)) == want
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 3)  # nothing new is remembered
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)  # every group by its different ids
    few = alignment.Aligner(A, B)
    for i in range(0, len(TEXTS), 4):
        assert plainly(few.aligned(TEXTS[i : i + 4])) == want[i : i + 4]
        assert len(few.names) <= 3 and len(few.keys) == len(few.times) == few.ends[-1] and len(few.ends) == len(few.names) + 1


def test_first_tokens_of_groups():
    a, b = alignment.np.array([1, 3, 4, 6, 7]), alignment.np.array([1, 2, 5, 6, 7])
    assert [x.tolist() for x in alignment.first_tokens(a, b)] == [[0, 1, 4], [0, 1, 4]]
    none = alignment.np.zeros(0, dtype=int)
    assert [x.tolist() for x in alignment.first_tokens(none, none)] == [[], []]


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None, "x", 1), ("b", None, 2), ("b", "", 3), ("c", long, 4), ("c", long, 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_a long").withColumn("pairs", F.lit("p")).withColumn("row", F.lit(0))
    got = alignment.alignments(docs, A, B).collect()
    assert sorted((r.doc_id or "", r.n_a > 0) for r in got) == [("", True), ("b", False), ("b", False), ("c", True), ("c", True)]
    assert len({tuple(r) for r in got if r.doc_id == "c"}) == 1 and max(r.n_a for r in got) > 60_000
    empty = alignment.alignments(docs.limit(0), A, B)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
