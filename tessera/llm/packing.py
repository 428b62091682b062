"""Best-fit packing of token sequences, with a swap-based local search between underfull bins.

A document is its token ids and an end mark; only longer ones than a bin are cut, into pieces of a bin's size. A plan
needs only how many pieces of each length there are: at most `capacity` numbers, whatever the input. Bins of equal
content are planned together as one pattern with a count.

1. Pieces by falling length go to the bins with the least room that takes them (best fit, decreasing).
2. Local search between underfull patterns: a move of one piece, or an exchange of one for one or two for one, is made
   where it increases the sum of squared fill; fuller bins fill up and the emptiest run empty. All bins that two
   patterns have in common are treated at once. The best partner of a bin is looked up in an index of rooms by length,
   and the search ends only when no change increases the sum, or the number of bins is the least possible.

The plan is broadcast as ranges: the k-th piece of length n has its bin and offset. A piece's rank among those of its
length is its number within its task, plus those of earlier tasks, so no length is ever gathered in one place. Pieces
are written to the shared folder before they are ranked, which fixes the numbers whatever executors are lost.

Null texts count as empty: a document of the end mark alone. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import tune, written

CAPACITY, END = 2048, 0
KNOWN_PARTS, PART_CHARS = 250_000, 32
#: After a letter a run of these is a pre-token of its own. Not < and >, as special tokens have them, nor the ' of short forms.
SIGNS = '!"#$%&()*+,-./:;=?@[\\]^_`{|}~'
#: Letters below are one code point in any normal form, and so are their lower cases.
LATIN = "\u0130"
#: The byte-level alphabet: a sign for each byte.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}
# Settings with which a tokenizer may be asked for a text's parts one by one.
BY_PARTS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def packed(ids: Iterable[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder(dict):
    """Ids of texts as unsigned 32-bit little-endian bytes; its items are those of parts without spaces.

    A tokenizer of BY_PARTS treats white space as a gap that no token crosses, so a text's ids are those of its parts
    between spaces or line ends. It lower-cases, and ends a word where SIGNS follow a letter, so most parts that are
    new have known ids but for their case or last signs; a word of Latin letters goes to the model without the other steps. A process remembers short parts: when there are
    KNOWN_PARTS of them they become the older half, of which only those that are met again stay. Any other tokenizer
    encodes each text as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        told = json.loads(self.tokenizer.to_str())
        marked = all(t["special"] and "<" in t["content"] and " " not in t["content"] for t in told["added_tokens"])
        self.by_parts = marked and all(told[k] == v for k, v in BY_PARTS.items()) and told["model"]["type"] == "BPE"

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.learned(part)
        if len(part) <= PART_CHARS:
            if len(self) >= KNOWN_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def learned(self, part: str) -> bytes:
        low = part.lower() if part.isascii() or max(part) < LATIN else part
        body = low.rstrip(SIGNS)
        if "<" in part:  # may hold a special token, whose case counts
            return self.fresh(part)
        if body and body != low and self.letter(body[-1]):
            return self[body] + self[low[len(body) :]]
        return self[low] if low != part else self.fresh(part)

    @staticmethod
    def letter(c: str) -> bool:
        """Whether c is a letter, and ends in one when it is normalised; some become a letter and a mark."""
        return c.isalpha() and (c < LATIN or unicodedata.normalize("NFC", c).lower()[-1].isalpha())

    def fresh(self, part: str) -> bytes:
        if part.isalpha() and part.islower():  # one word; Latin ones no normaliser changes
            if part.isascii():
                return packed([token.id for token in self.tokenizer.model.tokenize(part)])
            if max(part) < LATIN:
                return packed([token.id for token in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(BYTES))])
        return packed(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        if not self.by_parts:
            return packed(self.tokenizer.encode(text or "", add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs (doc_id, text), and its place: task, rank (among the task's pieces of its length)."""
    tune(docs.sparkSession)
    mark = packed([end])

    @F.pandas_udf("task long, length array<int>, crc array<long>, rank array<long>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, seen, task = encoder(path), Counter(), TaskContext.get().partitionId()
        for texts in parts:
            out = []
            for text in texts:
                ids = known.ids(text) + mark
                each = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
                lengths, ranks = [len(x) // 4 for x in each], []
                for n in lengths:
                    ranks.append(seen[n])
                    seen[n] += 1
                out.append((task, lengths, [zlib.crc32(x) for x in each], ranks))
            yield pd.DataFrame(out, columns=["task", "length", "crc", "rank"])
        known.older = {}  # what an idle worker keeps is the younger half

    rows = docs.select("doc_id", cut(F.col("text")).alias("c"))
    rows = rows.select("doc_id", "c.task", F.posexplode(F.arrays_zip("c.length", "c.crc", "c.rank")).alias("piece", "x"))
    return written(rows.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("x.length").cast("long").alias("length"), F.col("x.crc").alias("ids_crc32"), "task", "x.rank"), "packing-pieces")


Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def fill(p: Pattern) -> int:
    return sum(n * k for n, k in p)


def changed(p: Pattern, *changes: tuple[int, int]) -> Pattern:
    c = dict(p)
    for n, k in changes:
        c[n] = c.get(n, 0) + k
    return tuple(sorted(((n, k) for n, k in c.items() if k), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Patterns and their numbers, by best fit in decreasing order of length."""
    by_room: dict[int, Counter] = {}
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        for room in sorted(r for r in by_room if r >= n):
            if not left:
                break
            each = room // n
            for p in sorted(by_room[room], key=lambda p: (len(p), p)):
                bins = by_room[room][p]
                if not left:
                    break
                take = min(bins, left // each)
                rest = left - take * each if take < bins else 0
                for count, k in ((take, each), (1, rest)):
                    if count and k:
                        by_room[room][p] -= count
                        by_room.setdefault(room - n * k, Counter())[changed(p, (n, k))] += count
                        left -= count * k
                by_room[room] += Counter()
        each = capacity // n
        for count, k in ((left // each, each), (1, left % each)):
            if count and k:
                by_room.setdefault(capacity - n * k, Counter())[((n, k),)] += count
        by_room = {r: c for r, c in by_room.items() if c}
    return sum(by_room.values(), Counter())


class Underfull:
    """Patterns with room, by the lengths they hold (0: none asked for).

    rooms[n + d, n] is the least room of at least d that a pattern with length n has; NONE where there is none.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, {}
        self.rooms = np.full((capacity + 1, capacity + 1), self.NONE, dtype=np.int32)
        self.falling = np.arange(capacity, 0, -1, dtype=np.int64)

    def add(self, p: Pattern) -> None:
        room = self.capacity - fill(p)
        for n in (0, *(n for n, _ in p)) if room else ():
            of = self.held.setdefault((n, room), {})
            if not of:
                seen = self.rooms[n + 1 : n + room + 1, n]
                np.minimum(seen, room, out=seen)
            of[p] = None

    def remove(self, p: Pattern) -> None:
        room = self.capacity - fill(p)
        for n in (0, *(n for n, _ in p)) if room else ():
            of = self.held[n, room]
            del of[p]
            if not of:
                seen, above = self.rooms[n + 1 : n + room + 1, n], n + room + 1
                seen[seen == room] = self.rooms[above, n] if above <= self.capacity else self.NONE

    def exchange(self, a: Pattern) -> tuple[Pattern, Pattern, Pattern] | None:
        """The pattern b, fuller than a or equal, and the change between them that increases the sum of squares most.

        With d more tokens in b, the squares grow by 2 d (fill b - fill a + d); for a given d the least room is best.
        """
        room, best, found = self.capacity - fill(a), 0, None
        gives = {n: (n,) for n, _ in a}
        for i, (n, k) in enumerate(a):
            for m, _ in a[i:] if k > 1 else a[i + 1 :]:
                gives.setdefault(n + m, (n, m))
        for g, given in gives.items():
            lone = len(given) == 1  # two for none are two moves
            rooms, d = self.rooms[g, not lone : g], self.falling[self.capacity - g + (not lone) :]
            gain = np.where(rooms <= room, d * (room - rooms + d), 0)
            i = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[i] > best:
                best, found = gain[i], (given, i + (not lone), int(rooms[i]))
        if not found:
            return None
        given, taken, room_b = found
        b = next(iter(self.held[taken, room_b]))
        to_a, to_b = [(n, -1) for n in given], [(n, 1) for n in given]
        if taken:
            to_a, to_b = [*to_a, (taken, 1)], [*to_b, (taken, -1)]
        return b, changed(a, *to_a), changed(b, *to_b)


def local_search(bins: Counter, capacity: int) -> Counter:
    """Empties the emptiest bins into fuller ones; ends when the least number of bins is reached or no change is left."""
    bins = +bins
    total = sum(fill(p) * c for p, c in bins.items())
    least, number = -(-total // capacity), sum(bins.values())
    index = Underfull(capacity)
    if number > least:
        for p in sorted(bins):
            index.add(p)

    def put(p: Pattern, more: int) -> None:
        before = bins[p]
        bins[p] += more
        if p and not before:
            index.add(p)
        elif not bins[p]:
            del bins[p]
            if before:
                index.remove(p)

    improved = True
    while improved and number > least:
        improved, heap = False, [(fill(p), p) for p in bins if fill(p) < capacity]
        heapq.heapify(heap)
        while heap and number > least:
            _, a = heapq.heappop(heap)
            if a not in bins:
                continue
            lone = bins[a] == 1
            if lone:  # has no other bin of its kind to change with
                index.remove(a)
            to = index.exchange(a)
            if lone:
                index.add(a)
            if not to:
                continue
            improved, (b, *new) = True, to
            times = bins[a] // 2 if a == b else min(bins[a], bins[b])
            for p in (a, b):
                put(p, -times)
            for p in new:
                if p:
                    put(p, times)
                    if fill(p) < capacity:
                        heapq.heappush(heap, (fill(p), p))
            number -= times * (not new[0])
            if a in bins:
                heapq.heappush(heap, (fill(a), a))
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    return local_search(best_fit(histogram, capacity), capacity)


def ranges(bins: Counter) -> np.ndarray:
    """Rows (length, first rank, pieces of it in a bin, first bin, offset in the bin), sorted: where each rank goes."""
    at, first, out = Counter(), 0, []
    for p in sorted(bins):
        offset = 0
        for n, k in p:
            out.append((n, at[n], k, first, offset))
            at[n] += k * bins[p]
            offset += n * k
        first += bins[p]
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = pieces(docs, path, capacity, end)
    per_task = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(ranges(plan(histogram, capacity)))  # bounded by the number of lengths, not of pieces
    width = 1 + max(histogram.values(), default=1)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        p = places.value
        keys = p[:, 0] * width + p[:, 1]
        for length, rank in parts:
            n, r = length.to_numpy(), rank.to_numpy()
            i = np.searchsorted(keys, n * width + r, side="right") - 1
            b, j = np.divmod(r - p[i, 1], p[i, 2])
            yield pd.DataFrame({"sequence_id": p[i, 3] + b, "offset": p[i, 4] + j * n})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("earlier"))
    ranked = rows.join(starts, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    out = ranked.withColumn("at", placed("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
