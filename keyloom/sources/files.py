"""Files of a store through Hadoop's FileSystem, so that any path that Spark reads will do."""

from __future__ import annotations

import re
import time

from pyspark.sql import SparkSession

# The names of a store's files.
NAMES = {"manifest": r"MANIFEST-(\d{6})\.json", "log": r"(\d{6})\.log", "segments": r"(\d{6})\.seg"}


class StoreError(Exception):
    """An error whose text begins with its kind."""

    kind = "Error"

    def __str__(self) -> str:
        return f"{self.kind}: {': '.join(map(str, self.args))}"


class NotFound(StoreError):
    """What was asked for is not there."""

    kind = "not found"


class Corruption(StoreError):
    """Stored data can't be what was written."""

    kind = "corrupt"


class InvalidArgument(StoreError):
    """The call itself is wrong."""

    kind = "invalid argument"


class NotSupported(StoreError):
    """The engine doesn't offer this."""

    kind = "not supported"


class StoreIOError(StoreError):
    """The file system refused."""

    kind = "input or output failed"


def parse_name(name: str) -> tuple[str, int] | None:
    """Kind and number of an owned file's name; None for a stranger's."""
    for kind, pattern in NAMES.items():
        if m := re.fullmatch(pattern, name):
            return kind, int(m[1])
    return None


def file_name(kind: str, number: int) -> str:
    return {"manifest": "MANIFEST-%06d.json", "log": "%06d.log", "segments": "%06d.seg"}[kind] % number


class Files:
    """One folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since a file was last written."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def rename(self, name: str, to: str) -> None:
        """Give a file another name in the same folder tree; one that is there is not replaced."""
        if self.exists(to):
            raise InvalidArgument(f"{self.root}/{to}", "exists")
        if not self.exists(name):
            raise NotFound(f"{self.root}/{name}")
        if not self.fs.rename(self.path(name), self.path(to)):
            raise StoreIOError(f"{self.root}/{name}", "can't be renamed")

    def append(self, name: str, text: str) -> None:
        """Add to a file's end, where the file system can."""
        try:
            stream = self.fs.append(self.path(name)) if self.exists(name) else self.fs.create(self.path(name), False)
        except Exception as e:
            raise NotSupported(f"{self.root}/{name}", "can't be appended to") from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def mkdir(self) -> None:
        self.fs.mkdirs(self.path(""))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise NotFound(f"{self.root}/{name}")
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if another writer made it first. Readers may see it before it is whole."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise StoreIOError(str(e)[:300]) from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True
