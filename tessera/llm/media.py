"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

A payload is kept as a greyscale PNG of 64 samples of 8 bits a line, named by the SHA-256 of its samples. Each is
stored once: digests are computed first, and each goes to the first task that reads a text of it; a task then appends
the payloads that are its own to tar shards of SHARD_BYTES at most (one larger payload has a shard to itself). Texts are
read twice but never shuffled. Metadata columns come from range reads of the PNG headers alone (HEADER bytes at the
offset); digests and features from reads of whole payloads, once for each. A task makes both for its places, so they are
dealt once and meet the rows in one join; until then digests are bytes, for hexadecimal digits take twice their room.

A shard is named by its first payload's digest and takes that name when it is whole, so runs over the same partitions
give the same columns, and a task that is tried again, or twice at once, leaves one whole shard. Null texts count as
empty, which is one line of zeros. Rows stay as they are, repeated ones and null ids too; other columns are not read,
whatever their names. An empty table gives none. Texts of any length are whole in one payload.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, remove, tune, with_values, written
from .storage import create, opened, read_at, rename

WIDTH = 64
SHARD_BYTES, READ_BYTES = 256 << 20, 32 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR chunk
BLOCK = 512


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """8-bit greyscale, WIDTH samples a line, filter 0."""
    lines = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> dict[str, int]:
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png wrote; checksums are verified."""
    size, at, data = png_header(media[:HEADER]), HEADER, b""
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk's checksum differs")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size["height"], size["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of WIDTH, and their number without the zeros."""
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data)), len(data)


class Shards:
    """A task's tar shards; each payload is written once."""

    def __init__(self, folder: str):
        self.folder, self.known, self.out, self.at = folder, {}, None, 0

    def put(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if digest not in self.known:
            media = to_png(payload)
            if self.out is None or self.at + BLOCK + len(media) > SHARD_BYTES and self.at:
                self.close()
                self.name, self.at = f"{digest}.tar", 0
                self.part = f"{self.folder}/{digest}.{uuid.uuid4().hex}.part"
                self.out = create(self.part)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.known[digest] = self.name, self.at + len(head), len(media)
            pad = -len(media) % BLOCK
            self.out.write(head + media + bytes(pad))
            self.at += len(head) + len(media) + pad
        return self.known[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * BLOCK))
            self.out.close()
            rename(self.part, f"{self.folder}/{self.name}")
            self.out = None


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, digest (its bytes) and task of each row of docs (doc_id, text)."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", body.alias("b")).select("doc_id", "b", F.octet_length("b").cast("long").alias("n_bytes"))
    size = F.greatest(F.lit(WIDTH), F.ceil(F.col("n_bytes") / WIDTH) * WIDTH)
    digest = F.unhex(F.sha2(F.rpad("b", size.cast("int"), F.lit(b"\0")), 256))
    return rows.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), digest.alias("digest"), F.spark_partition_id().alias("task"))


def owned(folder: str, task: int) -> dict[bytes, int]:
    """The digests that a task has to store, and how many rows have each: those of its own file under the folder."""
    system, path = opened(f"{folder}/task={task}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    found = dataset(path, filesystem=system, format="parquet").to_table(["digest", "n"])
    return dict(zip(found["digest"].to_pylist(), found["n"].to_pylist(), strict=True))


def stored(docs: DataFrame) -> tuple[DataFrame, DataFrame, str] | None:
    """(rows as keyed, places (digest, __many: rows that have it, shard, offset, length), the shards' folder); None where docs
    was dealt to tasks otherwise when it was read again."""
    spark = docs.sparkSession
    folder, owners = new_dir(spark, "media"), new_dir(spark, "media-owners")
    rows = written(keyed(docs), "media-rows")
    rows.groupBy("digest").agg(F.min("task").alias("task"), F.count("*").alias("n")).repartition("task").write.partitionBy("task").parquet(owners)

    @F.pandas_udf("array<struct<digest:binary,__many:bigint,shard:string,offset:bigint,length:bigint>>")
    def put(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shards, mine = Shards(folder), owned(owners, TaskContext.get().partitionId())
        for texts in parts:
            out = []
            for text in texts:
                payload, _ = payload_of(text)
                raw = hashlib.sha256(payload).digest()
                many = mine.pop(raw, None)
                if many is not None:
                    out.append([{"digest": raw, "__many": many} | dict(zip(("shard", "offset", "length"), shards.put(raw.hex(), payload), strict=True))])
                else:
                    out.append([])
            yield pd.Series(out)
        shards.close()

    at = written(docs.select(F.explode(put(F.col("text"))).alias("s")).select("s.*"), "media-places")
    same = at.count() == spark.read.schema("digest binary").parquet(owners).count()
    remove(spark, owners)
    return (rows, at, folder) if same else None


def hexed(c: str) -> Column:
    return F.lower(F.hex(c)).alias(c)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(doc_id, n_bytes, payload_bytes, digest, task of each row; the places of all digests (digest, shard, offset, length); the folder of the shards)."""
    rows, at, folder = store_once(docs)
    return rows.withColumn("digest", hexed("digest")), at.select(hexed("digest"), "shard", "offset", "length"), folder


def store_once(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """As stored. Files are dealt to tasks alike whenever they are read; what is not read from files is written first."""
    tune(docs.sparkSession)
    done = stored(docs) or stored(written(docs.select("doc_id", "text"), "media-docs"))
    if not done:
        raise RuntimeError("the table was dealt to tasks otherwise when it was read again")
    return done


def ranges(rows: pd.DataFrame, folder: str, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Position in rows and the bytes at each row's place (its first `size` ones), shard by shard in order of offset."""
    rows = rows.reset_index(drop=True)
    for shard, group in rows.sort_values(["shard", "offset"]).groupby("shard", sort=False):
        with read_at(f"{folder}/{shard}") as f:
            for i, offset, length in zip(group.index, group["offset"], group["length"], strict=True):
                f.seek(offset)
                yield i, f.read(length if size is None else min(size, length))


def dealt(places: DataFrame) -> DataFrame:
    """places by shard, so that a task reads few files, but those of one shard to several tasks."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(n, "shard", (F.col("offset") / READ_BYTES).cast("long"))


METADATA = "width long, height long, bit_depth int, colour_type int"
CONTENTS = "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def heads(rows: pd.DataFrame, folder: str) -> pd.DataFrame:
    """METADATA of each of rows, by position."""
    got = {i: tuple(png_header(head).values()) for i, head in ranges(rows, folder, HEADER)}
    return pd.DataFrame.from_dict(got, orient="index", columns=names(METADATA))


def bodies(rows: pd.DataFrame, folder: str) -> pd.DataFrame:
    """CONTENTS of each of rows, by position; digests as bytes."""
    got = {}
    for i, media in ranges(rows, folder):
        payload = from_png(media)
        got[i] = hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).digest(), features(payload)
    return pd.DataFrame.from_dict(got, orient="index", columns=names(CONTENTS))


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """digest and METADATA of each of places, by range reads of the headers alone."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["digest"]].reset_index(drop=True).join(heads(b, folder))

    tune(places.sparkSession)
    return dealt(places).mapInPandas(task, f"digest string, {METADATA}")


def features(payload: bytes) -> str:
    """Exact sums: samples, zeros, sum, sum of squares, greatest sample, and a histogram of 16 equal bins."""
    x = np.frombuffer(payload, dtype=np.uint8)
    n = np.bincount(x, minlength=256)
    v = np.arange(256)
    bins = ".".join(map(str, n.reshape(16, 16).sum(axis=1)))
    return f"{len(x)}:{n[0]}:{n @ v}:{n @ (v * v)}:{x.max()}:{bins}"


def described(places: DataFrame, folder: str) -> DataFrame:
    """places (digests as bytes) with METADATA, by range reads of the headers alone, and CONTENTS, from the whole stored bytes.
    The payload's digest is compared with the one that it is stored under, so one column is both."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = bodies(b, folder)
            out = b.reset_index(drop=True).join(heads(b, folder)).join(whole)
            if (out["digest"] != out["payload_sha256"]).any():
                raise ValueError("a payload that was read back is not the one that was stored")
            yield out[list(b.columns) + [c for c in [*names(METADATA), *names(CONTENTS)] if c != "payload_sha256"]]

    tune(places.sparkSession)
    kinds = ", ".join(f"{c} {kind}" for c, kind in places.dtypes)
    rest = CONTENTS.replace("payload_sha256 string, ", "").replace("media_sha256 string", "media_sha256 binary")
    return dealt(places).mapInPandas(task, f"{kinds}, {METADATA}, {rest}")


def media_columns(docs: DataFrame) -> DataFrame:
    """Every row's place, METADATA and CONTENTS."""
    rows, at, folder = store_once(docs)
    rows = with_values(rows.drop("task"), written(described(at, folder), "media-known"), ["digest"], "__many")
    rows = rows.withColumn("payload_sha256", hexed("digest")).withColumn("media_sha256", hexed("media_sha256"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", *names(f"{CONTENTS}, {METADATA}"), "shard", "offset", "length")


def members(uri: str) -> list[tuple[str, bytes]]:
    """Names and contents of a shard, for tests."""
    with read_at(uri) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
        return [(m.name, t.extractfile(m).read()) for m in t.getmembers()]
