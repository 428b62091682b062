"""Commits: small files that come to be whole, once, under their number."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Makes a file of that content, at once and whole; False where there is one already. A writer that dies leaves a part
    of another name at most.

    The name is given by a hard link on local folders and by a rename elsewhere, neither of which replaces a file there.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    try:
        out.write(content)
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(target) and bool(fs.rename(part, target))
        old, new = (jvm.java.io.File(p.toUri().getPath()).toPath() for p in (part, target))
        jvm.java.nio.file.Files.createLink(new, old)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    finally:
        fs.delete(part, False)


class CommitLog:
    """Numbered commits in a folder. Each is a JSON object; of two writers of one number one fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def numbers(self) -> list[int]:
        """Oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def newest(self) -> int:
        """0 where there is none."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{number}", wholetext=True).first()[0])

    def write(self, number: int, content: dict) -> None:
        if not put_if_absent(self.spark, f"{self.folder}/{number}", json.dumps(content).encode()):
            raise FileExistsError(f"{self.folder} has a commit {number} of another writer")

    def made(self, number: int, content: dict) -> bool:
        """Whether that is the commit of that number: a writer that failed may have committed before."""
        return number in self.numbers() and self.read(number) == json.loads(json.dumps(content))
