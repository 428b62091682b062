"""Cross-tokenizer alignment: which tokens of A and of B cover the same bytes, and how often over the corpus.

The tokens of B are a static index of intervals: their starts and their ends, both sorted. Each token of A is a stabbing
query, answered by two bisections (searchsorted): the first token of B that ends behind its start, and the number of those
that start before its end. A gap between two tokens of B that no token of A spans is a boundary of groups.

Neither tokenizer has tokens that go on from a sign that is no white space to a space or line end, which is checked
against their vocabularies and settings. So a text is cut there into units, each tokenized and aligned once in a process and
remembered (KNOWN_UNITS short ones; the rest are aligned again in each batch). Other tokenizers get whole texts as one unit.

For each document, the linked id pairs are written with their numbers. How many documents hold a pair is counted over all
documents with partial sums in every task; counts go back to the documents by a broadcast of the pairs with one in
HOT_PAIRS of all rows or more (so HOT_PAIRS rows at most), and by a join for the rest, none of which is hot.

Null and empty texts, and those whose tokens' bytes are not those of a space and the text, have no tokens: zeros and ''. Rows
repeat as they are, each counts as a document. An empty table gives no rows; extra columns are not read. Texts count whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import tune, written

KNOWN_UNITS, UNIT_CHARS, HOT_PAIRS, LARGE_GROUP = 400_000, 32, 500_000, 4096
#: White space, then other signs, and on over white space that is neither a space nor a line end.
UNITS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
CROSSES = re.compile(r"\S[ \n]")
# The settings under which no token of A crosses from other signs to white space; the signs of bytes.
SPLITS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPACE, PREFIX = "▁", "x"


def byte_signs() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable ones stand for themselves, others follow 0x100."""
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


def first_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first token of A and the first of B of each group, of tokens that cover the same bytes and end at those places."""
    a_starts, b_starts = (np.concatenate([[0], x])[:-1] for x in (a_ends, b_ends))
    lo, hi = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")  # what each token of A overlaps
    new = np.ones(len(a_ends), dtype=bool)
    new[1:] = lo[1:] >= hi[:-1]  # no token so far spans the gap before its first one
    return np.flatnonzero(new), lo[new]


def sizes(first: np.ndarray, total: int) -> np.ndarray:
    return np.diff(first, append=total)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then those from first[1] on."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def numbers(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All in one, and how many each list has."""
    many = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=many.sum()), many


class Aligner:
    """Both tokenizers, and what is known of units: their groups as text, numbers of tokens, groups and links, and pairs."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs, vocabulary = byte_signs(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.b_size = len(pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in each]) for each in (self.a_bytes, self.b_bytes))
        self.signs = [f"{i}{mark}" for i in range(max(len(self.a_bytes), self.b_size)) for mark in ",|;\n"]
        self.before = self.b.encode(PREFIX)
        told = json.loads(self.a.to_str())
        whole = any(CROSSES.search(p.replace(SPACE, " ")) for p in pieces)
        self.by_units = not whole and told["normalizer"] is None and told["pre_tokenizer"] == SPLITS and told["model"]["type"] == "BPE"
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.texts: list[str] = []
        # numbers of tokens of A (none where bytes differ), of B, of groups and of links; pairs up to and with each unit
        self.numbers = [array("q") for _ in range(4)]
        self.ends, self.keys, self.times = array("q", [0]), array("q"), array("q")

    def units(self, text: str) -> list[str]:
        whole = " " + text  # B adds that space itself
        return UNITS.findall(whole) if self.by_units else [whole]

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """B's tokens of units: what it puts before a text is their first space, or is taken off."""
        led = [u[0] == " " and len(u) > 1 for u in units]  # an empty text gets no space
        ids = self.b.encode([u[1:] if own else PREFIX + u for u, own in zip(units, led, strict=True)], num_threads=1)
        k = len(self.before)
        if any(not own and i[:k] != self.before for i, own in zip(ids, led, strict=True)):
            raise ValueError(f"a token of B goes on from {PREFIX!r} to white space")
        return [i if own else i[k:] for i, own in zip(ids, led, strict=True)]

    def learn(self, units: list[str]) -> None:
        """Tokenizes and aligns new units, all together: tokens of neighbours never overlap."""
        if not units:
            return
        raw = [u.encode() for u in units]
        a, n_a = numbers([x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)])
        b, n_b = numbers(self.encode_b(units))
        good = self.same(raw, self.a_bytes, a, n_a) & self.same(raw, self.b_bytes, b, n_b)
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
        a_first, b_first = first_tokens(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        a_many, b_many = sizes(a_first, len(a)), sizes(b_first, len(b))
        unit = np.repeat(np.arange(len(units)), n_a)[a_first]
        n_groups = np.bincount(unit, minlength=len(units))
        n_links = np.bincount(unit, weights=a_many * b_many, minlength=len(units)).astype(np.int64)
        at, keys, times = self.pairs(a, b, a_first, b_first, a_many, b_many, unit)
        texts = self.told(a, b, a_first, b_first, a_many, b_many, unit)
        for i, u in enumerate(units, len(self.names)):
            self.index[u] = i
        self.names += units
        self.texts += [next(texts) if g else "" for g in n_groups.tolist()]
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.bincount(at, minlength=len(units)))).astype(np.int64).tobytes())
        for to, x in zip((*self.numbers, self.keys, self.times), (n_a, n_b, n_groups, n_links, keys, times), strict=True):
            to.frombytes(x.astype(np.int64).tobytes())

    def same(self, raw: list[bytes], known: list[bytes], ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Which units their tokens' bytes make up."""
        each = list(map(known.__getitem__, ids.tolist()))
        ends = np.cumsum(many).tolist()
        return np.fromiter((b"".join(each[s:e]) == r for s, e, r in zip([0, *ends], ends, raw, strict=False)), dtype=bool, count=len(raw))

    def pairs(self, a, b, a_first, b_first, a_many, b_many, unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, key and number of the linked pairs of each unit, in order."""
        large = a_many * b_many > LARGE_GROUP
        of = np.repeat(np.arange(len(a_first)), a_many)
        links = np.where(large, 0, b_many)[of]
        at, keys = [np.repeat(unit[of], links)], [np.repeat(a, links) * self.b_size + b[ranges(b_first[of], links)]]
        times = [np.ones(len(at[0]), dtype=np.int64)]
        for g in np.flatnonzero(large).tolist():  # one row for each pair of different ids
            p, n = np.unique(a[a_first[g] : a_first[g] + a_many[g]], return_counts=True)
            q, m = np.unique(b[b_first[g] : b_first[g] + b_many[g]], return_counts=True)
            keys.append(np.add.outer(p * self.b_size, q).ravel())
            times.append(np.multiply.outer(n, m).ravel())
            at.append(np.full(len(keys[-1]), unit[g]))
        at, keys, times = map(np.concatenate, (at, keys, times))
        order = np.lexsort((keys, at))
        at, keys, times = at[order], keys[order], times[order]
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(keys, prepend=-1) != 0))
        return at[new], keys[new], np.add.reduceat(times, new) if len(new) else times

    def told(self, a, b, a_first, b_first, a_many, b_many, unit) -> Iterator[str]:
        """The groups of each unit as text: ids between commas, a bar before those of B, semicolons between groups."""
        codes = np.zeros(len(a) + len(b), dtype=np.int64)
        a_at, b_at = a_first + b_first, b_first + a_first + a_many
        codes[ranges(a_at, a_many)], codes[ranges(b_at, b_many)] = 4 * a, 4 * b
        codes[a_at + a_many - 1] += 1
        codes[b_at + b_many - 1] += 2 + (np.diff(unit, append=-1) != 0)
        return iter("".join(map(self.signs.__getitem__, codes.tolist())).split("\n"))

    def forget(self, keep: int) -> None:
        """Drops all units but the first `keep`."""
        for u in self.names[keep:]:
            del self.index[u]
        del self.names[keep:], self.texts[keep:], self.ends[keep + 1 :]
        for x in self.numbers:
            del x[keep:]
        del self.keys[self.ends[-1] :], self.times[self.ends[-1] :]

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, groups_sha256, the linked pairs' keys and their numbers, for each text."""
        cut = [self.units(t) if t else [] for t in texts]
        new = {u for units in cut for u in units if u not in self.index}
        before = len(self.names)
        self.learn([u for u in new if len(u) <= UNIT_CHARS])
        keep = len(self.names) if len(self.names) <= KNOWN_UNITS else before
        self.learn([u for u in new if len(u) > UNIT_CHARS])
        numbers, ends = [np.frombuffer(x, dtype=np.int64) for x in self.numbers], np.frombuffer(self.ends, dtype=np.int64)
        keys, times = np.frombuffer(self.keys, dtype=np.int64), np.frombuffer(self.times, dtype=np.int64)
        for units in cut:
            at = np.fromiter(map(self.index.__getitem__, units), dtype=np.int64, count=len(units))
            if not len(at) or not numbers[0][at].all():
                yield 0, 0, 0, 0, "", at[:0], at[:0]
                continue
            u, many = np.unique(at, return_counts=True)
            size = ends[u + 1] - ends[u]
            place = ranges(ends[u], size)
            k, inverse = np.unique(keys[place], return_inverse=True)
            n = np.bincount(inverse, weights=times[place] * np.repeat(many, size)).astype(np.int64)
            digest = hashlib.sha256(";".join(map(self.texts.__getitem__, at.tolist())).encode()).hexdigest()
            yield *(int(x[at].sum()) for x in numbers), digest, k, n
        del numbers, ends, keys, times
        self.forget(keep)


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, the columns of one text's alignment and its linked pairs (k: A's id times B's size, and B's id; m: how often)."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        for part in parts:
            found = list(known.aligned(part.column(1).to_pylist()))
            *numbers, digests, keys, times = list(zip(*found, strict=True)) or [()] * 7
            offsets = pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32))
            flat = [pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x])) for x in (keys, times)]
            pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["k", "m"]))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), pairs], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<k: long, m: long>>")


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """k, n (how many of rows hold the pair), best (whether no other pair of its A id has more)."""
    counts = written(rows.select(F.explode("pairs.k").alias("k")).groupBy("k").agg(F.count("*").alias("n")), "alignment-counts")
    a = F.call_function("div", F.col("k"), F.lit(b_size))
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("k", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text)."""
    rows = written(aligned_rows(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "alignment")
    stats = written(pair_counts(rows, aligner(path_a, path_b).b_size), "alignment-pairs")
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * hot_pairs >= total
    hot, cold = stats.where(often), stats.where(~often)
    links = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.k", "p.m")
    met = links.join(F.broadcast(hot), "k").union(links.join(F.broadcast(hot.select("k")), "k", "left_anti").join(cold, "k").select("k", "row", "m", "n", "best"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
