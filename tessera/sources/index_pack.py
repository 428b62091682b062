"""Index packs: a header, a matrix of unit vectors, and ids in a file beside it; read and written as a data source.

Reading deals the rows of each pack out to tasks by range, each of which reads its own bytes. A pack is one file by
its format, so writing one is a single task's work. A folder of packs is written by all tasks at once (`save_packs`): each
writes packs of a bounded size and checks them as they were stored, and a tag that names them all is written last. A
reader takes what the tag names, or fails where a file is not the one that the tag was written for.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, VERSION, HEADER = b"CVIX", 1, struct.Struct("<4sIIII")
DTYPES = {0: np.dtype("<f4"), 1: np.dtype("<f2")}
#: The width that a pack without rows names.
EMPTY_DIM = 128
ROWS_PER_TASK, ROWS_PER_BATCH, SHARD_ROWS = 100_000, 10_000, 50_000
SCHEMA = "row bigint, id string, embedding array<float>"


class PackError(ValueError):
    pass


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def parse_header(head: bytes, strict: bool = True) -> tuple[np.dtype, int, int]:
    """(type of a number, rows, numbers in a row). Not strict: every type but the half one is read as single."""
    if len(head) < HEADER.size:
        raise PackError("index pack is truncated")
    magic, version, dtype, rows, dim = HEADER.unpack(head[: HEADER.size])
    if magic != MAGIC:
        raise PackError("not an index pack")
    if version != VERSION:
        raise PackError(f"unsupported index pack version {version}")
    if strict and dtype not in DTYPES:
        raise PackError(f"unsupported index dtype {dtype}")
    return DTYPES[1 if dtype == 1 else 0], rows, dim


def ids_of(text: str) -> list[str]:
    return [line.strip() for line in text.split("\n") if line.strip()]


def row_count(data: bytes) -> int:
    return parse_header(data, strict=False)[1]


def check_pair(data: bytes, ids: str) -> None:
    """Raises where a pack and its ids, fetched a moment apart, do not belong together."""
    rows, n = row_count(data), len(ids_of(ids))
    if rows != n:
        raise PackError(f"index pack has {rows} rows but {n} ids")


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1, norm)


def pack_bytes(matrix: np.ndarray, half: bool = True) -> bytes:
    rows, dim = matrix.shape
    body = unit_rows(np.asarray(matrix, dtype=np.float32)).astype(DTYPES[int(half)])
    return HEADER.pack(MAGIC, VERSION, int(half), rows, dim) + body.tobytes()


class RowRange(InputPartition):
    """Rows first to last of a pack; `start` is the number of rows in the packs before it."""

    def __init__(self, uri: str, first: int, last: int, start: int, strict: bool):
        self.uri, self.first, self.last, self.start, self.strict = uri, first, last, start, strict


#: The file of a folder that names its packs.
TAG = "_packs.json"


@dataclass
class Pack:
    """A pack of a folder as its tag has it: its first row, sizes, and digests of its two files."""

    name: str
    first: int
    rows: int
    dim: int
    bin_bytes: int
    ids_bytes: int
    bin_sha256: str
    ids_sha256: str


def tagged(uri: str) -> list[Pack] | None:
    """The packs that a folder's tag names, in order; None where there is no tag."""
    system, path = opened(uri)
    if system.get_file_info(f"{path.rstrip('/')}/{TAG}").type != fs.FileType.File:
        return None
    with system.open_input_file(f"{path.rstrip('/')}/{TAG}") as f:
        return [Pack(**p) for p in json.loads(f.read())["packs"]]


def check_sizes(uri: str, packs: list[Pack]) -> None:
    """Raises where a file is not of the size that its tag says."""
    system, path = opened(uri)
    names = [(f"{path.rstrip('/')}/{p.name}.{end}", size) for p in packs for end, size in (("bin", p.bin_bytes), ("ids", p.ids_bytes))]
    for info, (name, size) in zip(system.get_file_info([n for n, _ in names]), names, strict=True) if names else ():
        if info.type != fs.FileType.File or info.size != size:
            raise PackError(f"{name} is torn: {info.size} bytes, not {size}")


def check_digests(uri: str) -> int:
    """Reads all files of a tagged folder against their digests and each pack against its ids; the number of rows."""
    packs, (system, path) = tagged(uri) or [], opened(uri)
    for p in packs:
        parts = []
        for end, digest in (("bin", p.bin_sha256), ("ids", p.ids_sha256)):
            with system.open_input_file(f"{path.rstrip('/')}/{p.name}.{end}") as f:
                parts.append(f.read())
            if hashlib.sha256(parts[-1]).hexdigest() != digest:
                raise PackError(f"{p.name}.{end} is torn")
        check_pair(parts[0], parts[1].decode())
    return sum(p.rows for p in packs)


def packs_at(uri: str) -> list[str]:
    """The pack of that name, or those of a folder: those its tag names, or else all in order of their names."""
    system, path = opened(uri)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    packs = tagged(uri)
    if packs is not None:
        check_sizes(uri, packs)
        return [f"{uri.rstrip('/')}/{p.name}.bin" for p in packs]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(".bin"))
    return [f"{uri.rstrip('/')}/{n}" for n in names]


def exists(uri: str) -> bool:
    """Whether there is a pack: a reader of a missing one takes it for none (see read_pack)."""
    system, path = opened(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


class PackReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.strict = options["path"], options.get("strict", "true") == "true"

    def partitions(self):
        out, start = [], 0
        for uri in packs_at(self.uri):
            system, path = opened(uri)
            with system.open_input_file(path) as f:
                _, rows, _ = parse_header(f.read(HEADER.size), self.strict)
            out += [RowRange(uri, i, min(rows, i + ROWS_PER_TASK), start, self.strict) for i in range(0, max(rows, 1), ROWS_PER_TASK)]
            start += rows
        return out

    def read(self, part: RowRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without packs
            return
        system, path = opened(part.uri)
        beside = path.removesuffix(".bin") + ".ids"
        ids = []
        if system.get_file_info(beside).type == fs.FileType.File:
            with system.open_input_file(beside) as f:
                ids = ids_of(f.read().decode())
        with system.open_input_file(path) as f:
            dtype, rows, dim = parse_header(f.read(HEADER.size), part.strict)
            if part.strict and len(ids) != rows:
                raise PackError(f"index pack has {rows} rows but {len(ids)} ids")
            f.seek(HEADER.size + part.first * dim * dtype.itemsize)
            for first in range(part.first, part.last, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, part.last - first)
                values = pa.array(np.frombuffer(f.read(n * dim * dtype.itemsize), dtype=dtype).astype(np.float32))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), values)
                mine = [ids[i] if i < len(ids) else None for i in range(first, first + n)]
                rows_ = pa.array(np.arange(part.start + first, part.start + first + n), pa.int64())
                yield pa.RecordBatch.from_arrays([rows_, pa.array(mine, pa.string()), vectors], names=["row", "id", "embedding"])


def clean(uri: str, seconds: float = 86_400) -> None:
    """Removes what writes left that died: folders of packs that the tag does not name, with nothing younger than that."""
    (system, path), named = opened(uri.rstrip("/")), {p.name.split("/")[0] for p in tagged(uri) or []}
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.type == fs.FileType.Directory and info.base_name.startswith("packs-") and info.base_name not in named:
            inside = [info, *system.get_file_info(fs.FileSelector(info.path))]
            if max((i.mtime.timestamp() for i in inside if i.mtime), default=0) <= time.time() - seconds:
                system.delete_dir(info.path)


@dataclass
class Packs(WriterCommitMessage):
    packs: list[Pack]


class PackSetWriter(DataSourceArrowWriter):
    """Packs of a folder, in two phases. A task writes its rows, in order and without gaps, as packs of shard_rows at most
    under a name of this write alone, and reads each back. The commit checks that the packs follow on one another and writes
    the tag; an abort removes what the tasks wrote (a task that ends later leaves files that no tag names; see clean). Packs of
    the tag before go after the commit, unless rows were appended."""

    def __init__(self, options, overwrite: bool):
        self.uri, self.overwrite = options["path"].rstrip("/"), overwrite
        self.half, self.shard_rows = options.get("half", "true") == "true", int(options.get("shardrows", SHARD_ROWS))
        self.folder = f"packs-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packs:
        out, held = [], pa.table({"row": pa.array([], pa.int64())})
        for batch in iterator:
            part = pa.Table.from_batches([batch.select(["row", "id", "embedding"])])
            held = part if not held.num_rows else pa.concat_tables([held, part])
            while held.num_rows >= self.shard_rows:
                out.append(self.one(held.slice(0, self.shard_rows)))
                held = held.slice(self.shard_rows)
        return Packs(out + ([self.one(held)] if held.num_rows else []))

    def one(self, rows: pa.Table) -> Pack:
        numbers = rows["row"].to_numpy()
        if (np.diff(numbers) != 1).any():
            raise PackError(f"rows are not in order without gaps from {numbers[0]}")
        vectors = rows["embedding"].combine_chunks()
        dim = len(vectors[0])
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(flat) != rows.num_rows * dim:
            raise PackError("rows of different lengths")
        ids = rows["id"].to_pylist()
        if any(not i or i.strip() != i or "\n" in i for i in ids):
            raise PackError("an id is empty, or has spaces around it or lines")
        files = {"bin": pack_bytes(flat.reshape(rows.num_rows, dim), self.half), "ids": "\n".join(ids).encode()}
        (system, path), name = opened(self.uri), f"{self.folder}/{uuid.uuid4().hex}"
        system.create_dir(f"{path}/{self.folder}", recursive=True)
        for end, data in files.items():
            with system.open_output_stream(f"{path}/{name}.{end}", compression=None) as f:
                f.write(data)
            with system.open_input_file(f"{path}/{name}.{end}") as f:
                if f.read() != data:
                    raise PackError(f"{name}.{end} is torn")
        check_pair(files["bin"], files["ids"].decode())
        digests = [hashlib.sha256(files[end]).hexdigest() for end in ("bin", "ids")]
        return Pack(name, int(numbers[0]), rows.num_rows, dim, len(files["bin"]), len(files["ids"]), *digests)

    def commit(self, messages: list[Packs | None]) -> None:
        old = tagged(self.uri) or []
        packs = sorted((p for m in messages if m for p in m.packs), key=lambda p: p.first)
        packs = packs if self.overwrite else old + packs
        at = 0
        for p in packs:
            if p.first != at or p.dim != packs[0].dim:
                raise PackError(f"a pack begins at row {p.first}, not {at}, or has other numbers a row")
            at += p.rows
        check_sizes(self.uri, packs)
        system, path = opened(self.uri)
        system.create_dir(path, recursive=True)
        part = f"{path}/.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part, compression=None) as f:
            f.write(json.dumps({"rows": at, "packs": [asdict(p) for p in packs]}).encode())
        system.move(part, f"{path}/{TAG}")
        named = {p.name.split("/")[0] for p in packs}
        for gone in {p.name.split("/")[0] for p in old} - named:
            system.delete_dir(f"{path}/{gone}")
        clean(self.uri)

    def abort(self, messages: list[Packs | None]) -> None:
        system, path = opened(self.uri)
        if system.get_file_info(f"{path}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.folder}")


class IndexPackSource(DataSource):
    """spark.read.format("indexpack").load(path); option strict=false reads other types and packs without ids.

    df.write.format("indexpack").mode("overwrite").save(folder) writes rows (row, id, embedding), sorted within partitions of
    rows that follow on one another; mode append goes on after the folder's rows. Options: half, shardRows.
    """

    @classmethod
    def name(cls):
        return "indexpack"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PackReader(self.options)

    def writer(self, schema, overwrite):
        return PackSetWriter(self.options, overwrite)


def read_pack(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of a pack, or of all packs of a folder, numbered through. Where there is none, no rows."""
    spark.dataSource.register(IndexPackSource)
    if not exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("indexpack").option("strict", str(strict).lower()).load(path)


def save_packs(index: DataFrame, folder: str, half: bool = True, shard_rows: int = SHARD_ROWS, append: bool = False) -> None:
    """The rows (row, id, embedding) as packs of a folder, written by all tasks and visible all at once (see PackSetWriter).
    Rows are numbered without gaps, from 0 or, appended, from the folder's number of rows."""
    spark = index.sparkSession
    spark.dataSource.register(IndexPackSource)
    rows = index.select(F.col("row").cast("long"), F.col("id").cast("string"), F.col("embedding").cast("array<float>"))
    n = max(1, -(-rows.count() // shard_rows))
    rows = rows.repartitionByRange(n, "row").sortWithinPartitions("row")
    rows.write.format("indexpack").option("half", str(half).lower()).option("shardRows", shard_rows).mode("append" if append else "overwrite").save(folder)


def stale(uri: str, tag: str | None) -> bool:
    """Whether a pack is to be fetched: it is not there, has no stored tag, or another one. Without an answer (None): no."""
    if not exists(uri):
        return True
    system, path = opened(uri.removesuffix(".bin") + ".etag")
    if tag is None:
        return False
    if system.get_file_info(path).type != fs.FileType.File:
        return True
    with system.open_input_file(path) as f:
        return f.read().decode().strip() != tag


def install(source: str, target: str, tag: str | None) -> int:
    """Copies a pack and its ids, and stores its tag only if they belong together; the number of rows. A torn pair, or no
    tag, leaves none, so that the next run fetches again."""
    (there, path), (here, to) = opened(source), opened(target)
    here.create_dir(to.rsplit("/", 1)[0], recursive=True)
    stem, parts, mark = to.removesuffix(".bin"), [], f"{to.removesuffix('.bin')}.etag"
    if here.get_file_info(mark).type == fs.FileType.File:
        here.delete_file(mark)
    for end in ("bin", "ids"):
        with there.open_input_file(f"{path.removesuffix('.bin')}.{end}") as f, here.open_output_stream(f"{stem}.{end}", compression=None) as out:
            parts.append(f.read())
            out.write(parts[-1])
    check_pair(parts[0], parts[1].decode())
    if tag:
        with here.open_output_stream(mark, compression=None) as out:
            out.write(tag.encode())
    return row_count(parts[0])


def load_existing(spark: SparkSession, root: str, keys: DataFrame, game: str, at_most: str) -> DataFrame:
    """The newest stored index of a game no later than a version, of keys (key): its rows, or none (see read_pack)."""
    from ..operators.publish import newest_at_most

    found = newest_at_most(keys.withColumn("at_most", F.lit(at_most))).where(F.col("game") == game).first()
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    return read_pack(spark, f"{root}/games/{game}/index-{found['version']}.bin")


class PackWriter:
    """Appends rows to a pack of a known number of rows, a batch at a time; the files take their names when whole, so a
    task that is tried again, or twice at once, leaves one whole pack."""

    def __init__(self, uri: str, rows: int, half: bool):
        self.rows, self.half, self.done = rows, half, 0
        self.system, self.path = opened(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.names = [self.path, self.path.removesuffix(".bin") + ".ids"]
        self.parts = [f"{n}.{uuid.uuid4().hex}.part" for n in self.names]
        self.bin, self.ids = (self.system.open_output_stream(p, compression=None) for p in self.parts)

    def head(self, dim: int) -> None:
        self.bin.write(HEADER.pack(MAGIC, VERSION, int(self.half), self.rows, dim))

    def add(self, batch: pd.DataFrame) -> None:
        matrix = np.stack(batch["embedding"]).astype(np.float32)
        if not self.done:
            self.head(matrix.shape[1])
        self.bin.write(unit_rows(matrix).astype(DTYPES[int(self.half)]).tobytes())
        self.ids.write((("\n" if self.done else "") + "\n".join(batch["id"])).encode())
        self.done += len(batch)

    def close(self) -> int:
        if not self.done:
            self.head(EMPTY_DIM)
        self.bin.close()
        self.ids.close()
        if self.done != self.rows:
            raise PackError(f"{self.done} rows came, not {self.rows}")
        for part, name in zip(self.parts, self.names, strict=True):
            self.system.move(part, name)
        return self.done


def write_shards(index: DataFrame, folder: str, half: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs of at most shard_rows rows (row, id, embedding) in order of row, each by a task of its own: path, rows.
    Rows are numbered from 0 without gaps."""
    shard = F.floor(F.col("row") / shard_rows)

    def save(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path, rows = f"{folder}/part-{key[0]:06d}.bin", rows.sort_values("row")
        out = PackWriter(path, len(rows), half)
        for i in range(0, len(rows), ROWS_PER_BATCH):
            out.add(rows.iloc[i : i + ROWS_PER_BATCH])
        return pd.DataFrame({"path": [path], "rows": [out.close()]})

    return index.select("row", "id", "embedding", shard.alias("shard")).groupBy("shard").applyInPandas(save, "path string, rows long")


def write_pack(index: DataFrame, path: str, half: bool = True) -> int:
    """One pack of all rows, for a reader that takes a single file. By its format that is one task's work: it streams
    the rows in order, a batch at a time, so its memory does not grow with them."""
    n = index.count()

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for batch in batches:
            if len(batch):
                out = out or PackWriter(path, n, half)
                out.add(batch)
        if out:
            yield pd.DataFrame({"rows": [out.close()]})

    done = index.select("row", "id", "embedding").repartition(1).sortWithinPartitions("row").mapInPandas(save, "rows long").collect()
    return done[0]["rows"] if done else PackWriter(path, 0, half).close()
