"""JSON members of ZIP archives as a data source: a partition is some members of one archive, and a task holds one member at a time."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Packed bytes of members that one partition reads, about.
PARTITION_BYTES = 32 << 20


@dataclass
class Members(InputPartition):
    archive: str
    names: list[str]


class _File(io.RawIOBase):
    """A file of pyarrow's with the errors that zipfile expects."""

    def __init__(self, inner):
        self.inner, self.end, self.at = inner, inner.size(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.at, self.end)[whence]
        if at < 0:
            raise OSError("before the beginning of the file")
        self.at = at
        return at

    def readinto(self, into) -> int:
        got = self.inner.read_at(min(len(into), max(0, self.end - self.at)), self.at)
        into[: len(got)] = got
        self.at += len(got)
        return len(got)

    def close(self) -> None:
        self.inner.close()
        super().close()


def opened(path: str) -> io.BufferedReader:
    """A seekable file of any store that pyarrow knows: a local path, or a URI such as s3:// or hdfs://."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return io.BufferedReader(_File(store.open_input_file(inner)), 1 << 20)


class ZippedMembers(DataSource):
    """Options: path (an archive, or several parted by commas), suffix (of the members that count), bytes (of a partition).

    The driver reads the archives' directories, which stand at their ends; members are unpacked in the tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_members"

    def schema(self) -> str:
        return "archive string, member string, size bigint, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.suffix, self.bytes = options.get("suffix", ""), int(options.get("bytes", PARTITION_BYTES))

    def partitions(self) -> list[Members]:
        out = []
        for path in self.paths:
            names, size = [], 0
            with opened(path) as f, zipfile.ZipFile(f) as z:
                for i in z.infolist():
                    if i.is_dir() or not i.filename.endswith(self.suffix):
                        continue
                    if names and size + i.compress_size > self.bytes:
                        out.append(Members(path, names))
                        names, size = [], 0
                    names.append(i.filename)
                    size += i.compress_size
            if names:
                out.append(Members(path, names))
        return out

    def read(self, partition: Members | None) -> Iterator[tuple]:
        if partition is None:  # no members at all
            return
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                raw = z.read(name)
                yield partition.archive, name, len(raw), raw.decode("utf-8", "replace")


def read_members(spark: SparkSession, paths: list[str], schema: T.StructType | str, suffix: str = ".json", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """archive, member and value (by schema; null where a member isn't JSON) of the archives' members. A damaged member fails its task; an archive without members gives no rows."""
    spark.dataSource.register(ZippedMembers)
    rows = spark.read.format("zipped_members").options(path=",".join(paths), suffix=suffix, bytes=partition_bytes).load()
    return rows.select("archive", "member", F.from_json("value", schema).alias("value"))
