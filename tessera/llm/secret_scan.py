"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near hits, embedded checksums.

One automaton pass over the lower-cased text finds keyword hits (and four-digit hexadecimal seeds for the hex kind);
a regular expression is tried only at a hit, anchored there. Token kinds that embed a checksum are kept only when it
holds. Null texts count as empty. Spans are code points, end exclusive, ordered by start and then kind.

Rows stay as they are, repeated ones and null ids too; an empty table gives no rows. Texts of any length are scanned
whole. Extra columns are not read, whatever their names; redaction keeps them as they are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, tune

#: Base kinds first; the order breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3
ASSIGN, ACCESS, HEX, GITHUB, NPM = range(5)
KEYWORDS = {ASSIGN: ("password", "passwd", "secret", "token", "apikey", "api_key"), ACCESS: ("akia",), GITHUB: ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), NPM: ("npm_",)}
HEX_SEED = 4
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

RX_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
RX_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
RX_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
RX_CHECKED = {GITHUB: re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), NPM: re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i in range(16**HEX_SEED):
        a.add_word(f"{i:0{HEX_SEED}x}", (HEX, HEX_SEED))
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def checksum62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS62[d] + out
    return out


def lowered(text: str) -> str:
    """Lower case with every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret."""
    text = text or ""
    found, after = [], [0] * len(KINDS)
    for end, (kind, n) in automaton().iter(lowered(text)):
        start = end - n + 1
        if kind == HEX:
            if (start == 0 or text[start - 1] not in "0123456789abcdef") and (m := RX_HEX.match(text, start)):
                found.append((start, HEX, m.end()))
            continue
        if start < after[kind]:
            continue
        if kind == ASSIGN:
            if m := RX_ASSIGN.match(text, start):
                after[kind] = m.end()
                if m.end(2) - m.start(2) >= MIN_ASSIGN:
                    found.append((start, kind, m.end()))
        elif kind == ACCESS:
            if m := RX_ACCESS.match(text, start):
                after[kind] = m.end()
                if m.end() - start >= MIN_ACCESS:
                    found.append((start, kind, m.end()))
        elif (m := RX_CHECKED[kind].match(text, start)) and checksum62(m[1]) == m[2]:
            after[kind] = m.end()
            found.append((start, kind, m.end()))
    found.sort()
    return found


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def report(text: str | None) -> tuple[int, int, int, str, str]:
    spans = scan(text)
    base = [x for x in spans if x[1] < BASE]
    count = [sum(k == kind for _, k, _ in base) for kind in range(BASE)]
    return (*count, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans))


def redact(text: str | None) -> str | None:
    """The text with each secret (overlapping ones together) replaced by a mark of the first one's kind."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def secrets(text: Column) -> Column:
    """A struct of SCHEMA for a text column."""

    @F.pandas_udf(SCHEMA)
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for s in parts:
            yield pd.DataFrame([report(t) for t in s], columns=names)

    return udf(text)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of docs (doc_id, text)."""
    tune(docs.sparkSession)
    return docs.select("doc_id", secrets(F.col("text")).alias("s")).select("doc_id", "s.*")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars (where there is such a column) brought up to date."""
    tune(docs.sparkSession)

    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([redact(t) for t in s], dtype=object)

    old, new = "text", free_name(docs.columns, "redacted")
    out = docs.withColumn(new, udf(F.col(old)))
    chars = next((c for c in docs.columns if c.lower() == "n_chars"), None)
    cols = [F.col(new).alias(c) if c == old else (F.when(F.col(new) == F.col(old), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c) if c == chars else F.col(c)) for c in docs.columns]
    return out.select(*cols)
