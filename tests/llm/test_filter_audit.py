"""The filter audit against plain runs of every order."""

import re
from itertools import permutations

from tessera.llm import filter_audit


def failed(text, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if first:
        out.add("E")
    return out


def wanted(rows, labels):
    """Every order runs over every document."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None and (t or "") not in firsts or i is not None and i < firsts[t or ""]:
            firsts[t or ""] = i
    docs = [(s or "", failed(t or "", i is not None and i > firsts[t or ""]), any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)) for i, t, s in rows]
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, here = [d for d in left if f in d[1]], [d for d in mine if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(here) - len(gone), sum(d[1] == {f} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def made():
    good = " ".join(f"w{i}" for i in range(250))
    bits = ["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, " same" * 300]
    texts = [None, "", "short", "short", good, good + " \x0b", *(base + a + b for base in ("short words", good) for a in bits for b in bits)]
    rows = [(i, t, ["x", "y", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(None, good, "x"), (None, "short", "y"), (4, good, "x"), (90, good, ""), (91, None, "one"), (92, "é" * 49 + "A", "x"), (93, "é" * 51 + "A", "x")]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 60, 3)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (90, None, None), (5, 7, 1)]
    return rows, [(i, q, None if x is None else int(x)) for i, q, x in labels]


def test_against_every_order(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, text string, source string, part string, digest string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, marks)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    want = wanted(rows, labels)
    assert len(want) == 600 * 4 and got == want
    assert dict(out.dtypes)["shapley"] == "bigint" and filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).selectExpr("sum(good_lost + toxic_lost)").first()[0] == 0


def test_transform_gives_back_the_masks(spark):
    masks = [0, 0, 1, 5, 31, 31, 31, 16]
    rows = spark.createDataFrame([("p", m % 2 == 0, m > 20, m) for m in masks], "part string, good boolean, toxic boolean, mask int")
    r = filter_audit.cells(rows).first()
    assert r.n == [masks.count(m) for m in range(32)]
    assert r.n_good == [masks.count(m) * (m % 2 == 0) for m in range(32)] and r.n_toxic == [masks.count(m) * (m > 20) for m in range(32)]
