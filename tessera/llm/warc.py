"""WARC archives: records compressed one by one with a Zstandard dictionary that the archive itself carries.

Each task writes archives of its own. It holds back records up to SAMPLE_BYTES, trains a dictionary on slices of them
(and on a few made records, so that there is always enough to train on), writes it in a leading skippable frame (magic
0x184D2A5D, compressed), and then one frame for each record. An archive ends once ARCHIVE_BYTES are written.

A response carries the page's payload in an HTTP message. Of records with equal payloads of at least `min_bytes` the
one with the smallest page_id is the response; the others are revisits (identical-payload-digest) that keep the HTTP
head and the digest but no payload. Payloads are compared by digest (SHA-1) and length before anything is written, by
a partially aggregated minimum; the rows of a payload that very many share are not gathered to learn it (see
common.with_values).

Null html counts as empty; a null url is about:blank. Null ids come after all others and may refer to one; rows with
the smallest id repeated are responses all. Ids may be of any type that orders and casts to text. Extra columns are not
read, whatever their names; an empty table gives no rows. Html of any length is whole in one record.

An archive takes its name when it is whole; names are unique to the attempt that wrote them, and only those of finished
attempts are read back.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, tune, with_values, written
from .storage import create, read_at, rename

MAGIC = 0x184D2A5D
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, LEVEL = 4 << 20, 64 << 10, 512 << 20, 3
SLICE, MADE = 4 << 10, 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{page_id}:{digest}')}>"


def uri_of(url: str | None) -> str:
    """A URL that fits one header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "about:blank"


def record(page_id: str | None, url: str | None, html: str | None, first: str | None, is_response: bool) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    digest, kind = base32_sha1(payload), "response" if is_response else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri_of(url)}", "Content-Type: application/http;msgtype=response"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", *([] if page_id is None else [f"X-Page-ID: {quote(page_id)}"])]
    if not is_response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest, 'response')}", *([] if first is None else [f"X-Refers-To-Page-ID: {quote(first)}"])]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; its block digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    block = rest[:n]
    if not first.startswith("WARC/") or rest[n:] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("not a whole WARC record")
    return headers, block


def dictionary(samples: Iterable[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on slices of the samples after MADE records of this module's own."""
    made = (record(str(i), f"http://host{i}.example/{i * 7919}", f"<html><head><title>{i}</title></head><body><p>{i * i}</p></body></html>", None, True) for i in range(MADE))
    slices = [s[i : i + SLICE] for s in itertools.chain(made, samples) for i in range(0, len(s), SLICE)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in slices if len(s) >= 8], level=LEVEL)


class Archive:
    """One archive of a task. Records wait for the dictionary until SAMPLE_BYTES have come."""

    def __init__(self, folder: str):
        self.name, self.waiting, self.held, self.size, self.records, self.out = f"{folder}/{uuid.uuid4().hex}.warc.zst", [], 0, 0, 0, None
        self.part = f"{self.name}.part"

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.out is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= SAMPLE_BYTES:
                self.begin()
        else:
            self.write(self.packer.compress(data))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def begin(self) -> None:
        self.out = create(self.part)
        known = dictionary(self.waiting)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
        self.write(struct.pack("<II", MAGIC, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        for data in self.waiting:
            self.write(self.packer.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self.begin()
        self.out.close()
        rename(self.part, self.name)
        return self.name, self.size, self.records


def write(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, n_bytes, n_records) of the archives that hold a record for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    tune(spark)
    folder = new_dir(spark, "warc")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.unhex(F.sha1(body)).alias("sha"), F.octet_length(body).alias("n"))
    first = rows.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    rows = with_values(rows, written(first, "warc-first"), ["sha", "n"], "rows")
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("first").cast("string"), (F.col("page_id").eqNullSafe(F.col("first")) | (F.col("n") < min_bytes)).alias("is_response"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, archive = [], None
        for b in batches:
            for page_id, url, html, first, is_response in b.itertuples(index=False):
                archive = archive or Archive(folder)
                archive.add(record(page_id, url, html, first, is_response))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["archive", "n_bytes", "n_records"])

    return written(rows.mapInPandas(task, "archive string, n_bytes long, n_records long"), "warc-index")


def frames(uri: str) -> Iterator[bytes]:
    """The records of an archive in order, one decompressed frame at a time; its own dictionary is read first."""
    with read_at(uri) as f:
        known, head = None, f.read(8)
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == MAGIC:
            packed = f.read(struct.unpack("<I", head[4:])[0])
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
            head = b""
        packer, rest = zstandard.ZstdDecompressor(dict_data=known), head
        while True:
            unpack, out = packer.decompressobj(), io.BytesIO()
            while not unpack.eof:
                data = rest or f.read(1 << 20)
                if not data:
                    if out.tell():
                        raise ValueError("an archive ends within a record")
                    return
                out.write(unpack.decompress(data))
                rest = b""
            rest = unpack.unused_data
            yield out.getvalue()


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    return map(parsed, frames(uri))


def columns(id_type: str) -> str:
    return f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}"


def read(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The columns of every record in the archives (column archive). A response's digest and length are those of what
    it holds; a revisit's those that it names."""
    names = [x.split()[0] for x in columns("string").split(", ")]

    def id_of(s: str | None) -> str | None:
        return None if s is None else unquote(s)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["archive"]:
                out = []
                for headers, block in records(uri):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = next(int(x.partition(":")[2]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    if kind == "response" and (n != len(payload) or digest != base32_sha1(payload)):
                        raise ValueError(f"a payload in {uri} differs from its digest")
                    out.append((id_of(headers.get("x-page-id")), n, digest, kind, id_of(headers.get("x-refers-to-page-id"))))
                    if len(out) == 4096:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out = []
                yield pd.DataFrame(out, columns=names, dtype=object)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = archives.select("archive").repartition(n).mapInPandas(task, columns("string"))
    return rows.select(*[F.col(c).cast(id_type).alias(c) if c in ("page_id", "refers_to") else F.col(c) for c in names])


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page, then read the archives back."""
    return read(write(pages, min_bytes), pages.schema["page_id"].dataType.simpleString())
