"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most `max_distance` bits are linked. The 64 bits are cut into
max_distance // 2 + 1 segments, so that of a linked pair at least one segment differs in at most one bit. Each
segment is indexed once for each of its bits, with that bit masked out; an equality join on these variants meets
every linked pair, and the join condition verifies the distance. A pair is taken at one signature only (its first
segment within one bit; the differing bit, or the segment's first bit when equal), so no pair is made twice.

Copies are collapsed to distinct fingerprints before the join; they cost nothing however many there are.

Near copies by similarity (`keep_representatives`) differ in more bits than segments guarantee. There each text has
FINGERPRINTS fingerprints of independent hashes over its set of shingles, and keys of some of all their bits. The keys'
width grows with the number of texts, so that few meet by chance, and their number so that the computed share of pairs
at SIMILARITY with a key in common stays at KEY_RECALL (`key_recall`). Candidates are within NEAR of 64 bits, in the
first fingerprint and over all (of pairs at SIMILARITY, one in 100,000 is not), and only count as near copies when the
exact Jaccard similarity of their shingles is SIMILARITY or more.

A group of near copies could make pairs with the square of its size. So each key has a leader, the same for many keys of a
group. Texts and their near leaders (the LEADERS first in the turn's order, and as many of the nearest) make clusters. In
each of TURNS turns, with leaders of its own, a text is compared with the CLOSEST of its leaders that are of other
components; in a tight group that leaves little. Then what is still apart within a cluster is compared exactly, by blocks
(module tiles), and so are all near pairs of different clusters that have a key in common (`across`). So the bounds on
leaders only order the work: no link of texts with a common key is missed, whatever the turns found.

Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Rows with a null
doc_id keep their row; the smallest non-null doc_id names the component. Repeated rows stay as they are; an empty table
gives no rows; extra columns are not read, whatever their names. Texts of any length count whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .common import SHARES, connected_components, free_name, release, release_grown, shuffled, tune, with_values, written

SEED = 42
FINGERPRINTS, KEY_BITS, KEY_RECALL, NEAR, TURNS, CLOSEST, LEADERS = 8, 16, 0.99, 22, 2, 3, 5
#: Pairs that one copy of a set serves in a join.
PAIRS_PER_SET = 2_000
#: Of keys: most are different, so a task counts them in a table of about as many rows.
ROWS_PER_TASK = 1 << 20
SIMILARITY = 4, 5  # as a fraction, so that the bound is exact
#: Bits that a signature's value has at most; the number of the masked bit is above them.
WIDTH = 56
CHUNK = 1 << 15


def fingerprints(text: str | None, words: int = 4, count: int = 1, seed: int = SEED) -> list[int]:
    """Signed 64-bit SimHashes over `words`-word shingles, repeats included, of the text with A-Z lower-cased.

    The first is over XXH64 of the shingles, others over mixes of that hash.
    """
    h, ones = hashes(text, words, seed), np.zeros((count, 64), dtype=np.int64)
    for i in range(0, len(h), CHUNK):
        for k in range(count):
            ones[k] += bit_sums(mixed(h[i : i + CHUNK], k) if k else h[i : i + CHUNK])
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def hashes(text: str | None, words: int = 4, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle in order (a shorter text is one); none of a text without words."""
    tokens = (text or "").encode().lower().split()  # bytes.split() parts at exactly 0x20 and 0x09-0x0D
    if not tokens:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(tokens)
    starts = np.zeros(len(tokens), dtype=np.int64)
    np.cumsum(np.fromiter(map(len, tokens[:-1]), dtype=np.int64, count=len(tokens) - 1) + 1, out=starts[1:])
    n = max(1, len(tokens) - words + 1)
    ends = np.append(starts[words:] - 1, len(joined))[:n] if len(tokens) >= words else np.array([len(joined)])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends.tolist(), strict=True)), dtype="<u8", count=n)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits; sums of 255 rows fit in bytes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    q = len(bits) // 255 * 255
    whole = bits[:q].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return whole + bits[q:].sum(axis=0, dtype=np.uint8)


def set_fingerprints(text: str | None, words: int = 5, count: int = FINGERPRINTS) -> list[int]:
    """`count` fingerprints over the set of shingles (repeats count once, as in a Jaccard similarity), and their number."""
    h, ones = np.unique(hashes(text, words)), np.zeros((count, 64), dtype=np.int64)
    for i in range(0, len(h), CHUNK):
        for k in range(count):
            ones[k] += bit_sums(mixed(h[i : i + CHUNK], k) if k else h[i : i + CHUNK])
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").view("<i8")[:, 0].tolist() + [len(h)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash for each hash: the finaliser of SplitMix64 after k steps."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    return fingerprints(text, words, 1, seed)[0]


def per_text(text: Column, of: Callable[[str | None], list[int] | np.ndarray]) -> Column:
    """The numbers that `of` gives for each text (array<long>)."""

    @F.pandas_udf("array<long>")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([of(t) for t in s], dtype=object)

    return udf(text)


def simhash(text: Column, words: int = 4) -> Column:
    """The fingerprint column (long) of a text column."""
    return simhashes(text, words, 1)[0]


def simhashes(text: Column, words: int, count: int) -> Column:
    """A column of `count` fingerprints (array<long>) of a text column."""
    return per_text(text, lambda t: fingerprints(t, words, count))


def set_simhashes(text: Column, words: int, count: int) -> Column:
    """`count` fingerprints of the set of shingles, and the number of shingles last."""
    return per_text(text, lambda t: set_fingerprints(t, words, count))


def shingle_sets(text: Column, words: int) -> Column:
    """The distinct shingles of a text column, as hashes (array<long>)."""
    return per_text(text, lambda t: np.unique(hashes(t, words)).view("<i8"))


def segments(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of n segments."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def exact_segments(max_distance: int) -> int:
    """Segments of which one differs in at most one bit whatever the max_distance bits are."""
    return max_distance // 2 + 1


def recall(bits: int, n: int) -> float:
    """The share of pairs that differ in so many bits (placed at random) of which some of n segments has at most one."""
    from math import comb

    ways = {0: 1}  # of bits placed so that all segments so far have two or more
    for _, width in segments(n):
        new: dict[int, int] = {}
        for used, w in ways.items():
            for here in range(2, min(width, bits - used) + 1):
                new[used + here] = new.get(used + here, 0) + w * comb(width, here)
        ways = new
    return 1 - ways.get(bits, 0) / comb(64, bits)


def part(x: Column, lo: int, n: int) -> Column:
    return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


ONE = "shiftleft(1L, p)"  # the masked bit p, in its place


def by_segment(segs: list[tuple[int, int]], bit: Column, f: Callable[[int, int, int], Column]) -> Column:
    """f(number, first bit, bits) of the segment that a bit is in."""
    out = f(0, *segs[0])
    for j, (lo, n) in enumerate(segs[1:], 1):
        out = F.when(bit >= lo, f(j, lo, n)).otherwise(out)
    return out


def signatures(rows: DataFrame, n: int, of: str = "fp") -> DataFrame:
    """The columns of rows with k: for each bit, the value of its segment of fingerprint `of` without that bit, after
    the bit's number."""
    segs, fp = segments(n), F.col(of)
    value = by_segment(segs, F.col("p"), lambda j, lo, w: part(fp.bitwiseAND(F.bitwise_not(F.expr(ONE))), lo, w))
    index = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return index.select(*rows.columns, F.shiftleft(F.col("p").cast("long"), WIDTH).bitwiseOR(value).alias("k"))


def first_signature(x: Column, k: Column, n: int) -> Column:
    """Whether k is the first of the signatures that two fingerprints with differing bits x share."""
    segs, bit = segments(n), F.shiftright(k, WIDTH).cast("int")

    def here(j: int, lo: int, w: int) -> Column:
        # the differing bit, or the segment's first bit when it is equal
        own = F.shiftleft(part(x, lo, w), lo)
        first = (own == F.call_function("shiftleft", F.lit(1).cast("long"), bit)) | ((own == 0) & (bit == lo))
        for lo2, w2 in segs[:j]:
            first = first & (F.bit_count(part(x, lo2, w2)) > 1)
        return first

    return by_segment(segs, bit, here)


def links(rows: DataFrame, max_distance: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of column fp that differ in at most max_distance bits: all of them.

    A row makes 64 of the index, which Spark's estimate from the files' bytes does not know: it would broadcast the index,
    and so pass it through the driver. Both sides are therefore shuffled and sorted.
    """
    n = exact_segments(max_distance)
    index = signatures(rows.select("fp").distinct(), n)
    left, right = index.hint("merge").alias("l"), index.hint("merge").alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    verified = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(x) <= max_distance) & first_signature(x, F.col("l.k"), n)
    return left.join(right, (F.col("l.k") == F.col("r.k")) & verified).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def key_width(classes: int) -> int:
    """Bits of a key: so many that by chance four in five rows have a key for themselves."""
    return max(KEY_BITS, math.ceil(math.log2(max(1, classes))) + 2)


def key_recall(share: float, keys: int, width: int, bits: int = 64 * FINGERPRINTS) -> float:
    """The share of pairs with some key in common, of those that differ in each bit with probability `share`."""
    met = lambda d: 1 - (1 - math.comb(bits - d, width) / math.comb(bits, width)) ** keys
    return sum(math.comb(bits, d) * share**d * (1 - share) ** (bits - d) * met(d) for d in range(bits + 1))


def keys_for(width: int, recall: float = KEY_RECALL) -> int:
    """Keys of that width that give pairs at SIMILARITY this key_recall; multiples of eight."""
    s = SIMILARITY[0] / SIMILARITY[1]
    share, keys = math.acos(2 * s / (1 + s)) / math.pi, 8
    while key_recall(share, keys, width) < recall:
        keys += 8
    return keys


def key_positions(bits: int, keys: int, width: int) -> np.ndarray:
    """The bit positions of each key (keys x width): random, and apart among the bits // width keys of each deal."""
    rng, each = np.random.default_rng(SEED), bits // width
    deals = [rng.permutation(bits)[: each * width].reshape(each, width) for _ in range(-(-keys // each))]
    return np.concatenate(deals)[:keys]


def keyed(rows: DataFrame, width: int, count: int) -> DataFrame:
    """cid, f0 (the first fingerprint) and k (a key after its number) of rows (cid, fps), for each of `count` keys."""

    @F.pandas_udf("array<long>")
    def keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = place = None
        for s in parts:
            bits = np.unpackbits(np.stack(s.to_numpy()).astype("<i8").view(np.uint8), axis=1, bitorder="little")
            if at is None:
                at, place = key_positions(bits.shape[1], count, width), np.arange(count, dtype=np.int64) << width
            values = np.zeros((len(s), count), dtype=np.int64)
            for i in range(width):
                values |= bits[:, at[:, i]].astype(np.int64) << i
            yield pd.Series(list(values | place), dtype=object)

    return rows.select("cid", F.col("fps")[0].alias("f0"), keys("fps").alias("ks")).select("cid", "f0", F.explode("ks").alias("k"))


def shared_keys(classes: DataFrame) -> DataFrame:
    """cid, f0, k, n of classes (cid, fps): the keys that n of them have, more than one."""
    size = classes.count()
    width = key_width(size)
    count = keys_for(width)
    parts = max(1, -(-size * count // ROWS_PER_TASK))
    index = written(keyed(classes.select("cid", "fps").repartition(parts), width, count), "simhash-index")
    many = written(index.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    return written(with_values(index, many, ["k"], "n", size * count).where("n IS NOT NULL"), "simhash-shared")


def near_enough(near: int, similarity: tuple[int, int] = SIMILARITY) -> Column:
    """Whether x and y (fps, size) may be similar: d differing bits over all fingerprints, and sizes alike enough."""
    of, per = similarity
    sizes = per * F.least("x.size", "y.size") >= of * F.greatest("x.size", "y.size")
    return (F.col("d") <= near * F.size("x.fps")) & sizes


def differing() -> Column:
    bits = F.zip_with("x.fps", "y.fps", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, n: s + n)


def near_leaders(shared: DataFrame, known: DataFrame, near: int, turn: int, first: int = LEADERS) -> DataFrame:
    """(a, b, d): each cid of known (cid, component, fps, size) and leaders of its keys that are of other components and
    near enough; d is in how many bits they differ. Of its near leaders a cid takes the `first` ones in the turn's order,
    which it has in common with most of its group, and as many of the nearest ones. What that leaves out, `across` compares.

    A key's leader has the least f0 after an exclusive or with a mask of the turn, so a group has few leaders in one turn,
    and others in the next. Least values are partially aggregated and joined back: no key's rows are ever gathered.
    """
    mask = F.xxhash64(F.lit(turn))
    least = shared.groupBy("k").agg(F.min(F.col("f0").bitwiseXOR(mask)).alias("g0"), F.count("*").alias("n"))
    led = with_values(shared.drop("n"), written(least.withColumn("g0", F.col("g0").bitwiseXOR(mask)), "simhash-least"), ["k"], "n")
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0")))
    met = led.where(apart <= near).select("cid", "g0", apart.alias("bits")).distinct()
    ranks = [F.row_number().over(Window.partitionBy("cid").orderBy(*order)) for order in ((F.col("g0").bitwiseXOR(mask),), ("bits", "g0"))]
    met = met.withColumn("r", F.least(*ranks)).where(F.col("r") <= first).select("cid", "g0")
    mine = known.select("cid", "component", F.struct("fps", "size").alias("x"))
    leaders = known.groupBy(F.col("fps")[0].alias("g0")).agg(F.min("cid").alias("cid")).join(mine, "cid")
    leaders = leaders.select("g0", F.col("cid").alias("b"), F.col("component").alias("other"), F.col("x").alias("y"))
    pairs = met.join(leaders, "g0").join(mine, "cid").where("component <> other").withColumn("d", differing())
    return pairs.where(near_enough(near)).select(F.col("cid").alias("a"), "b", "d")


def closest(pairs: DataFrame, most: int = CLOSEST) -> DataFrame:
    """(a, b) of the pairs (a, b, d) with least d of each a."""
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).select("a", "b")


def salted(pairs: DataFrame, values: DataFrame, key: str, total: int, each: int = PAIRS_PER_SET, most: int | None = None) -> DataFrame:
    """pairs with the other columns of values (key, n: how many pairs have it, ...). A key of more than `each` pairs, or one in
    SHARES of all, gets a copy of its values for so many pairs: only keys and numbers are broadcast, SHARES rows at most, and
    nothing where no key has so many (`most`: of the commonest, if known)."""
    per = max(each, total // SHARES + 1)
    if most is not None and most <= per:
        return pairs.join(values.drop("n"), key)
    copies = F.ceil(F.col("n") / per).cast("int")
    hot = values.where(F.col("n") > per).select(key, copies.alias("copies"))
    spread = F.coalesce(F.pmod(F.xxhash64(*pairs.columns), F.col("copies")), F.lit(0)).cast("int")
    left = pairs.join(F.broadcast(hot), key, "left").withColumn("salt", spread).drop("copies")
    right = values.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n")
    return left.join(right, [key, "salt"]).drop("salt")


def similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts (cid, text) have a Jaccard similarity of shingles of at least that; only texts of
    pairs are read."""
    many = written(times(pairs), "simhash-times")
    total, most = many.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    sets = written(texts.join(many, "cid").select("cid", "n", shingle_sets(F.col("text"), words).alias("v")), "simhash-shingles")
    for c, v in (("a", "x"), ("b", "y")):  # a leader may be in very many pairs
        pairs = salted(pairs, sets.select(F.col("cid").alias(c), F.col("v").alias(v), "n"), c, total, most=most)
    of, per = similarity
    both = F.size(F.array_intersect("x", "y"))
    return pairs.where(per * both >= of * (F.size("x") + F.size("y") - both)).select("a", "b")


def across(shared: DataFrame, rows: DataFrame, classes: DataFrame, near: int) -> DataFrame:
    """(a, b): all pairs of cids with a key of shared (cid, f0, k) in common that are of different clusters of rows (cid,
    cluster) and near enough by classes (cid, fps, size); whatever leaders the turns have taken.

    Of such a pair at least one is not of the cluster that most rows of the key are of. So only those others are met with a
    key's rows: a key of one cluster costs nothing, and one of a large cluster and few others its rows times the others.
    """
    mine = written(shared.select("cid", "f0", "k").join(rows.select("cid", "cluster"), "cid"), "simhash-clustered")
    by = mine.groupBy("k", "cluster").agg(F.count("*").alias("many"))
    by = by.groupBy("k").agg(F.max(F.struct("many", "cluster"))["cluster"].alias("main"), F.sum("many").alias("n"), F.count("*").alias("clusters"))
    main = written(by.where("clusters > 1").select("k", "main", "n"), "simhash-mixed")
    mixed = with_values(mine, main, ["k"], "n").where("main IS NOT NULL")
    left, right = mixed.where("cluster <> main").hint("merge").alias("l"), mixed.hint("merge").alias("r")
    apart = (F.col("l.cluster") != F.col("r.cluster")) & (F.bit_count(F.col("l.f0").bitwiseXOR(F.col("r.f0"))) <= near)
    pairs = left.join(right, (F.col("l.k") == F.col("r.k")) & apart)
    pairs = pairs.select(F.least("l.cid", "r.cid").alias("a"), F.greatest("l.cid", "r.cid").alias("b")).distinct()
    for c, v in (("a", "x"), ("b", "y")):
        pairs = pairs.join(classes.select(F.col("cid").alias(c), F.struct("fps", "size").alias(v)), c)
    return written(pairs.withColumn("d", differing()).where(near_enough(near)).select("a", "b"), "simhash-across")


def times(pairs: DataFrame) -> DataFrame:
    """(cid, n): in how many pairs each cid is."""
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n"))


def between(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): which components of known (cid, component) the pairs (a, b) of cids join; few, once most are one."""
    ends = [known.select(F.col("cid").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    both = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b").where("ca <> cb")
    return both.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct()


def joined(known: DataFrame, edges: DataFrame, to: str = "component", lone: bool = False) -> DataFrame:
    """known with column `to`: the components that edges between components make of those of known. `lone`: each row of
    known is a component of its own, so none has many rows."""
    release(known.sparkSession)
    found = written(connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("__to")), "simhash-joined")
    rows = known.join(found, "component", "left") if lone else with_values(known, found, ["component"])
    rows = rows.withColumn("__to", F.coalesce("__to", "component"))
    return written(rows.select(*[c for c in known.columns if c != to], F.col("__to").alias(to)), "simhash-known")


def near_copies(classes: DataFrame, texts: DataFrame, words: int, near: int = NEAR, turns: int = TURNS) -> DataFrame:
    """(cid, component) of classes (cid, fps, size), each with what it is linked to; texts (cid, text) decide."""
    shared, known, met = shared_keys(classes), classes.withColumn("component", F.col("cid")), []
    for turn in range(turns):
        release(classes.sparkSession)
        met.append(written(near_leaders(shared, known, near, turn), "simhash-met"))
        release_grown(classes.sparkSession)
        links = written(similar(closest(met[-1]), texts, words), "simhash-links")
        # before the first turn a text is a component of its own
        known = joined(known, between(links, known) if turn else links, lone=not turn)
    known = known.select("cid", "component", "size")
    rows = joined(known, between(reduce(DataFrame.union, met), known), "cluster")
    release(classes.sparkSession)
    others = across(shared, rows, classes, near)
    apart = rows.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = written(rows.join(apart.select("cluster"), "cluster", "left_semi"), "simhash-apart")
    sets = written(texts.join(rows.select("cid"), "cid", "left_semi").select("cid", shingle_sets(F.col("text"), words).alias("v")), "simhash-sets")
    links = written(tiles.links(rows, sets, SIMILARITY).union(similar(others, texts, words)), "simhash-links")
    return joined(known, between(links, known)).select("cid", "component")


def components(prints: DataFrame, max_distance: int = 4) -> DataFrame:
    """(fp, component_id, n) for each distinct fp of `prints` (doc_id, fp): the smallest doc_id of all linked
    fingerprints, and the number of rows with it."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    cc = written(connected_components(links(classes, max_distance)).withColumnRenamed("node", "fp"), "simhash-components")
    low = cc.join(classes, "fp").groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("many"))
    linked = with_values(cc, low, ["component"], "many").select("fp", "low")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"), "n")


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text)."""
    tune(docs.sparkSession)
    prints = written(docs.select("doc_id", simhash(F.col("text"), words).alias("fp")), "simhash")
    # copies of one text may be a large share of all rows
    named = with_values(prints, written(components(prints, max_distance), "simhash-named"), ["fp"], "n")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, words: int = 5, count: int = FINGERPRINTS) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest doc_id (null ids come last), then
    by row order. Columns stay as they are.

    Shingles with a Jaccard similarity s differ in acos(2 s / (1 + s)) / pi of all bits on average: at 0.8 that is 9.7
    of 64. Copies with equal fingerprints (all 512 bits) are one class before any join. Each group keeps one row by a
    partially aggregated minimum over (doc_id, row number).
    """
    tune(docs.sparkSession)
    fps, row = (free_name(docs.columns, c) for c in ("fps", "row"))
    rows = written(docs.withColumn(fps, set_simhashes(F.col("text"), words, count)).withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    prints = F.slice(fps, 1, count).alias("fps")
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r"), F.col(fps)[count].alias("size"))
    classes = rows.select(prints, at.alias("at")).groupBy("fps").agg(F.min("at").alias("at"))
    classes = written(classes.select("fps", "at", F.col("at.r").alias("cid"), F.col("at.size").alias("size")), "simhash-classes")
    texts = rows.select(F.col(row).alias("cid"), "text")  # a class is known by the row of its first document
    with shuffled(docs.sparkSession):
        cc = near_copies(classes.select("cid", "fps", "size"), texts, words)
    release(docs.sparkSession)
    first = classes.join(cc, "cid").groupBy("component").agg(F.min("at").alias("at"))
    return rows.join(first.select(F.col("at.r").alias(row)), row, "left_semi").select(*docs.columns)
