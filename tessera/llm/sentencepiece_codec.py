"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each end position the automaton's output links are followed from the longest piece down, and each piece that ends
there relaxes the best score; of equal scores the longer last piece stays, as in SentencePiece's own search. A
character without a piece of its own may always be an unknown, of the least score less UNKNOWN_PENALTY, written as byte
pieces where the vocabulary has them. Pieces, scores and the normaliser's settings come from the model file; nothing is trained.

The segmentation is the one of greatest total score (the unigram search). For a file of the BPE kind SentencePiece
itself applies merges in order of score instead, so the ids may differ from its own; decoding is the same for both.

No piece of such a vocabulary has a word mark after another sign (checked on loading; a vocabulary that has is searched
as a whole), so a text is the sequence of its words and each word is searched once: KNOWN_WORDS of them are remembered.

Null texts give no pieces, as empty ones do. Lone surrogates cannot occur in Spark strings. Rows stay as they are,
repeated ones and null ids too; an empty table gives none; extra columns are not read, whatever their names. Texts of
any length are searched whole, word by word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KNOWN_WORDS, WORD_CHARS = 400_000, 64
COLUMNS = "n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


class Codec:
    """One model file's pieces, automaton and normaliser settings."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.index({self.pieces[i]: (i, sp.get_score(i)) for i in normal})
        # the file's normaliser: whether a text gets a mark in front, and whether runs of spaces are kept
        self.prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        self.keeps_spaces = sp.decode(sp.encode("a  a")) == "a  a"
        self.normalize = sp.normalize
        self.known: dict[str, tuple[int, ...]] = {}

    def index(self, scored: dict[str, tuple[int, float]]) -> None:
        """Takes pieces with their ids and scores."""
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in scored.items():
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.lone = {p for p in scored if len(p) == 1}
        self.unknown_score = min(score for _, score in scored.values()) - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in scored)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a normalised text."""
        n, lone, unknown_score = len(text), self.lone, self.unknown_score
        best, came, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [self.unknown] * (n + 1)
        at = 1  # positions before it are settled
        for end, (i, size, score) in self.automaton.iter(text):
            while at <= end:  # all pieces that end at this position have come
                if text[at - 1] not in lone and (total := best[at - 1] + unknown_score) > best[at]:
                    best[at], came[at], piece[at] = total, at - 1, self.unknown
                at += 1
            start = end + 1 - size
            if (total := best[start] + score) > best[end + 1]:
                best[end + 1], came[end + 1], piece[end + 1] = total, start, i
        for at in range(at, n + 1):
            if text[at - 1] not in lone and (total := best[at - 1] + unknown_score) > best[at]:
                best[at], came[at], piece[at] = total, at - 1, self.unknown
        out = []
        while n:
            if piece[n] == self.unknown:
                signs = text[came[n] : n].encode()
                out += [self.byte[b] for b in reversed(signs)] if self.byte else [self.unknown]
            else:
                out.append(piece[n])
            n = came[n]
        out.reverse()
        return out

    def normalized(self, text: str) -> str:
        return self.normalize(text) if text else ""

    def words(self, text: str) -> list[str]:
        """Parts that are searched on their own: a run of marks and what follows it."""
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text) if self.by_word else [text]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for w in self.words(self.normalized(text or "")):
            ids = self.known.get(w)
            if ids is None:
                ids = tuple(self.viterbi(w))
                if len(w) <= WORD_CHARS:
                    if len(self.known) >= KNOWN_WORDS:
                        self.known.clear()
                    self.known[w] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined to UTF-8 (what is not gets U+FFFD), marks become spaces."""
        out, waiting = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                waiting.append(self.byte_of[i])
                continue
            if waiting:
                out.append(waiting.decode("utf-8", "replace"))
                waiting.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        if waiting:
            out.append(waiting.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(text: Column, path: str) -> Column:
    """The ids (array<int>) of a text column."""

    @F.pandas_udf("array<int>")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([codec(path).encode(t) for t in s], dtype=object)

    return udf(text)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids; null ids give null."""

    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if x is None else codec(path).decode(x) for x in s], dtype=object)

    return udf(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and COLUMNS of each row of docs (doc_id, text): the number and CRC-32 (unsigned, of the ids as unsigned
    32-bit little-endian numbers) of the pieces, the SHA-256 of the text decoded from them, and whether that is the
    text itself (word marks in it read as spaces)."""
    tune(docs.sparkSession)

    @F.pandas_udf(COLUMNS)
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for s in parts:
            rows = []
            for t in s:
                ids = c.encode(t)
                text = c.decode(ids)
                rows.append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), hashlib.sha256(text.encode()).hexdigest(), text == (t or "").replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COLUMNS.split(", ")])

    return docs.select("doc_id", udf(F.col("text")).alias("s")).select("doc_id", "s.*")
