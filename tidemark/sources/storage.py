"""Readers with explicit schemas, and sinks with the keyed, idempotent and versioned ways to write."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVIDER_BARS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adjusted_close", "volume"))])


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where it is unset and all tasks run in this process (tests) a temporary one stands in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a short plan that outlives lost executors and reads only the columns it needs."""
    path = f"{shared_dir(df.sparkSession)}/cut-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType = PROVIDER_BARS) -> DataFrame:
    """Provider rows; what doesn't parse comes back as nulls for validate() to reject."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_zipped_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON members of ZIP archives, an archive a row: member name and parsed value."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        yield pd.DataFrame({"member": [name], "value": [z.read(name).decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(members, "member string, value string").select("member", F.from_json("value", schema).alias("value"))


def validate(rows: DataFrame, order: str | None = None) -> DataFrame:
    """rows (PROVIDER_BARS) with session and reason; reason is null for valid ones. Every row is kept.

    Reasons in order: invalid_row, invalid_date, duplicate_date, invalid_numeric, non_positive_price,
    negative_volume, invalid_ohlc. Of a ticker's rows of one date the first holds the date, whatever comes of it, and the
    others are duplicates: the first by the column `order`, the source's own, or without one the first sound row by content.
    All rows go through one window; those without ticker or date are spread in it by a hash of the row, so nulls are no hot key.
    """
    prices = ("open", "high", "low", "close", "adjusted_close")
    day = F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))
    bad_number = F.lit(False)
    for c in (*prices, "volume"):
        bad_number = bad_number | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    slack = F.col("high") * 1e-12
    shape = (F.col("high") + slack < F.greatest("open", "close", "low")) | (F.col("low") - slack > F.least("open", "close", "high"))
    own = (
        F.when(bad_number, "invalid_numeric")
        .when(F.least(*prices) <= 0, "non_positive_price")
        .when(F.col("volume") < 0, "negative_volume")
        .when(shape, "invalid_ohlc")
    )
    judged = rows.withColumn("session", day).withColumn("reason", own)
    dated = F.col("ticker").isNotNull() & F.col("session").isNotNull()
    place = [order] if order else [F.col("reason").isNotNull()]
    spread = F.when(~dated, F.xxhash64(*prices, "volume", "date", "ticker"))
    k = F.row_number().over(Window.partitionBy("ticker", "session", spread).orderBy(*place, *prices, "volume"))
    lost = F.when(F.col("ticker").isNull() | F.col("date").isNull(), "invalid_row").otherwise("invalid_date")
    return judged.withColumn("reason", F.when(~dated, lost).when(k > 1, "duplicate_date").otherwise(F.col("reason")))


def adjusted(rows: DataFrame) -> DataFrame:
    """Valid rows with prices times adjusted_close / close, and a segment that grows where over 180 days lack."""
    w = Window.partitionBy("ticker").orderBy("session")
    factor = F.col("adjusted_close") / F.col("close")
    gap = F.when(F.datediff("session", F.lag("session").over(w)) > 180, 1).otherwise(0)
    out = rows.select("ticker", "session", *((F.col(c) * factor).alias(c) for c in ("open", "high", "low", "close")), "volume", gap.alias("__gap"))
    return out.withColumn("segment", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Keyed upsert: a new row takes the place of the old one with its key, and of new rows with one key the last wins.

    order: the column of new that says which is last; it is left out of the result unless old has it. Without it, and
    among rows tied in it, the greatest row by content is the last. Null keys are equal to each other.
    """
    rest = [c for c in old.columns if c not in keys]
    fields = F.struct(*rest) if rest else F.struct(F.lit(1).alias("one"))
    best = F.max_by(fields, F.struct(*([F.col(order).alias("__at")] if order else []), fields.alias("__row"))).alias("__best")
    last = new.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    kept = old.alias("o").join(last.alias("n"), same, "left_anti")
    return kept.unionByName(last.select(*old.columns))


def _known(new: DataFrame, old: DataFrame, keys: list[str], how: str) -> DataFrame:
    """new (as n) joined with old (as o) where all keys are equal, null to null as well."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"n.`{k}`").eqNullSafe(F.col(f"o.`{k}`"))
    return new.alias("n").join(old.alias("o"), same, how)


def unknown(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key isn't in old, one of each key."""
    return _known(new.dropDuplicates(keys), old, keys, "left_anti").select(*(f"`{c}`" for c in old.columns))


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent append: new rows whose key is known are left out, and of new rows with one key one stays. Null keys are equal to each other."""
    return old.unionByName(unknown(old, new, keys))


def ledger_append(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append that refuses a key with two payloads, among the new rows or against the old ones; the same payload again is nothing new.

    Null keys are equal to each other, and so are null fields; a frame is read as it is, so what is null is part of the payload.
    """
    rest = [c for c in old.columns if c not in keys]
    payload = F.sha2(F.to_json(F.struct(F.lit(1).alias("__one"), *(F.col(f"`{c}`") for c in rest)), {"ignoreNullFields": "false"}), 256)
    marks = new.groupBy(*keys).agg(F.min(payload).alias("__low"), F.max(payload).alias("__high"))
    inside = marks.where("__low <> __high").select(*keys)
    against = _known(marks, old.select(*keys, payload.alias("__mark")), keys, "inner").where("o.__mark <> n.__low").select(*(F.col(f"n.`{k}`") for k in keys))
    clash = inside.unionByName(against).limit(3).collect()
    if clash:
        raise ValueError(f"keys with two payloads: {clash}")
    return appended(old, new, keys)


def replace_snapshot(df: DataFrame, path: str, parts: list[str]) -> None:
    """Writes df and replaces just the partitions that it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def content_path(root: str, identity: dict) -> str:
    """A cache path that the identity of what is cached decides."""
    return f"{root}/{hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()}"


def checksum(df: DataFrame) -> str:
    """Of a frame's rows in any order: their number and the sum of their hashes, added up by Spark."""
    row = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in df.columns))
    r = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{df.schema.json()}|{r['n']}|{r['s'] or 0}".encode()).hexdigest()


def store_artifact(df: DataFrame, root: str, identity: dict) -> str:
    """Writes df under its content path, with its checksum beside it; an artifact that is there stays. Gives the path."""
    spark, path = df.sparkSession, content_path(root, identity)
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        df.write.mode("overwrite").parquet(f"{path}/data")
        found = [(checksum(spark.read.parquet(f"{path}/data")), json.dumps(identity, sort_keys=True, default=str))]
        spark.createDataFrame(found, "checksum string, identity string").withColumn("stored_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return path


def load_artifact(spark: SparkSession, root: str, identity: dict) -> DataFrame | None:
    """The artifact of an identity, or None: if there is none, or if its rows don't have the stored checksum."""
    path = content_path(root, identity)
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        return None
    df = spark.read.parquet(f"{path}/data")
    return df if checksum(df) == spark.read.parquet(f"{path}/manifest").first()["checksum"] else None


def prune_artifacts(spark: SparkSession, root: str, keep: int) -> int:
    """Deletes all but the `keep` newest artifacts under root; says how many went. Ties go by path."""
    if not _exists(spark, root):
        return 0
    manifests = spark.read.parquet(f"{root}/*/manifest").select("stored_at", F.col("_metadata.file_path").alias("file"))
    old = manifests.orderBy(F.desc("stored_at"), "file").select(F.regexp_extract("file", r"/([0-9a-f]{64})/manifest/", 1).alias("name")).offset(keep).collect()
    for r in old:
        _delete(spark, f"{root}/{r['name']}")
    return len(old)


def publish(df: DataFrame, path: str) -> None:
    """One report as JSON, CSV and Markdown: written aside first, then put in place as a whole, or not at all.

    The report at path stays until the new one is complete, and comes back if putting it in place fails.
    """
    spark, aside, before = df.sparkSession, f"{path}.new", f"{path}.before"
    _delete(spark, aside)
    try:
        df.coalesce(1).write.json(f"{aside}/json")
        df.coalesce(1).write.option("header", True).csv(f"{aside}/csv")
        spark.createDataFrame([(markdown(df),)], "value string").coalesce(1).write.text(f"{aside}/md")
    except Exception:
        _delete(spark, aside)
        raise
    _delete(spark, before)
    had = _exists(spark, path)
    if had:
        _rename(spark, path, before)
    if not _rename(spark, aside, path):
        if had:
            _rename(spark, before, path)
        raise OSError(f"{path} could not be put in place")
    _delete(spark, before)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, a: str, b: str) -> bool:
    fs, p = _fs(spark, a)
    return fs.rename(p, _fs(spark, b)[1])


def encode_frame(df: DataFrame) -> DataFrame:
    """One column, payload: each row as JSON with its types beside it, packed with zlib's format by Spark's tasks."""
    import zlib
    from collections.abc import Iterator

    import pandas as pd

    schema = df.schema.json()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            body = "\n".join([schema, *pdf["row"]])
            yield pd.DataFrame({"payload": [zlib.compress(body.encode())]})

    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("row")).mapInPandas(run, "payload binary")


def decode_frame(payloads: DataFrame, schema: T.StructType, limit: int = 64 << 20) -> DataFrame:
    """The rows of encode_frame(). A payload of another schema, or one that unpacks to over `limit` bytes, is an error."""
    import zlib
    from collections.abc import Iterator

    import pandas as pd

    want = schema.json()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for raw in pdf["payload"]:
                unpack = zlib.decompressobj()
                body = unpack.decompress(raw, limit + 1)
                if len(body) > limit or unpack.unconsumed_tail:
                    raise ValueError(f"a payload unpacks to over {limit} bytes")
                head, *rows = body.decode().split("\n")
                if head != want:
                    raise ValueError("a payload has another schema")
                yield pd.DataFrame({"row": rows})

    return payloads.select("payload").mapInPandas(run, "row string").select(F.from_json("row", schema).alias("r")).select("r.*")


def write_versioned(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """A table of the first rows, for reports; the frame is cut by Spark before it comes to the driver."""
    some = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in some])
