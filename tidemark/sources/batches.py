"""Keyed tables that a stream writes batch by batch: a batch that comes again changes nothing.

A table is a folder with data folders and a ledger. Rows are dealt into buckets by key. A batch writes the buckets that it touches
anew, into a folder of its own, and is committed by one small ledger file that is made only if it isn't there; the
file names, for each bucket, the folders that hold it. What a run wrote before it was killed is in no ledger, so nobody
reads it, and the batch is written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.storage import cut, merged, unknown

LEDGER = "_ledger"


class BatchTable:
    """A keyed table at `path`. buckets: into how many files sets the keys are dealt; a batch rewrites those that it touches."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        if not self.fs.exists(self._path(LEDGER)):
            return []
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self._path(LEDGER)) if s.getPath().getName().isdigit())

    def _entry(self) -> dict[str, list[str]]:
        """The folders of each bucket after the last committed batch."""
        done = self.batches()
        if not done:
            return {}
        stream = self.fs.open(self._path(f"{LEDGER}/{done[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, batch: int, entry: dict[str, list[str]]) -> None:
        draft = self._path(f"{LEDGER}/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(json.dumps(entry).encode())
        stream.close()
        if not self.fs.rename(draft, self._path(f"{LEDGER}/{batch}")):
            raise RuntimeError(f"batch {batch} was committed by another writer")

    def _rows(self, entry: dict[str, list[str]], buckets: list[str] | None = None) -> DataFrame:
        folders = sorted({f"{self.path}/{f}/bucket={b}" for b, fs in entry.items() if buckets is None or b in buckets for f in fs})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """All rows as of the last committed batch."""
        return self._rows(self._entry())

    def _bucket(self):
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def apply(self, rows: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame], replaces: bool) -> bool:
        """Takes a batch in, unless it was before: combine(old, new) gives the rows to write of the buckets that it touches. False for a batch known already.

        replaces: what combine gives takes the place of the touched buckets; else it is added to them. Batches come in order of their numbers,
        as a streaming query's do.
        """
        done = self.batches()
        if batch in done or done and batch < done[-1]:
            return False
        entry = self._entry()
        new = cut(rows)
        touched = [str(r[0]) for r in new.select(self._bucket().alias("b")).distinct().collect()]  # as many as buckets at most
        if touched:
            made = combine(self._rows(entry, touched), new).select(*(f"`{c}`" for c in self.schema.names)).withColumn("bucket", self._bucket())
            folder = f"data-{batch}-{uuid.uuid4().hex}"
            made.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written = {s.getPath().getName().split("=")[1] for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("bucket=")}
            for b in touched:
                kept = [] if replaces else entry.get(b, [])
                entry[b] = [*kept, *([folder] if b in written else [])]
        self._commit(batch, entry)
        return True

    def upsert(self, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a new row takes the place of the old one with its key; of a batch's rows of one key the last by `order` wins."""
        return lambda rows, batch: self.apply(rows, batch, lambda old, new: merged(old, new, self.keys, order), True) and None

    def append(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: rows whose key is known are left out, and those of one key in a batch are one."""
        return lambda rows, batch: self.apply(rows, batch, lambda old, new: unknown(old, new, self.keys), False) and None

