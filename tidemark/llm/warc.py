"""WARC fixity: Merkle trees over records and ordered offset ranges, and an audit of two replicas.

Records are laid end to end into files of a bounded number of records. A leaf is the hash of a record with
its place; a node is the hash of FANOUT children in order with the range that they cover. A file's root stands over
its leaves, and the archive's root over the files' roots. An audit compares the archives' roots and goes down only
below nodes that differ: each level of a tree is stored apart, and of a level only the suspects' span is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_order, materialize, scratch_path

#: Children of a node, and records of a file. A file has room for FANOUT ** height(FILE_RECORDS) places.
FANOUT, FILE_RECORDS = 16, 240


def record(url: Column, page_id: Column, body: Column) -> Column:
    """The bytes of one resource record, as a string: fixed header fields, then the body's UTF-8 length."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(F.coalesce(body, F.lit(""))).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"))


def placed(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """page_id, file, place (in the file, from 0), size and content of each page's record, in order of page_id.

    Null columns count as empty (a null page_id comes first and is named `none`). Rows that repeat a
    page_id follow each other in any order: the sort reads no content, so that finding its ranges is cheap.
    """
    text = record(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select("page_id", text.alias("content")).withColumn("size", F.octet_length("content").cast("long"))
    ordered = in_order(rows, ["page_id"], "records", "zstd")
    # One row for each range partition.
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("base"))
    out = ordered.join(F.broadcast(parts), "part").withColumn("number", F.col("base") + F.col("row"))
    return out.select("page_id", F.expr(f"number div {file_records}").alias("file"), (F.col("number") % file_records).alias("place"), "size", "content")


def with_offsets(rows: DataFrame) -> DataFrame:
    """rows with offset, the bytes of their file before them; a window holds one file, which is bounded."""
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))


def archive(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """placed() with offsets: what a writer of the files needs."""
    return with_offsets(placed(pages, file_records)).select("page_id", "file", "place", "offset", "size", "content")


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def height(file_records: int) -> int:
    """Levels from a file's leaves to its root."""
    levels = 1
    while FANOUT**levels < file_records:
        levels += 1
    return levels


def leaf(offset: Column, size: Column, own: Column) -> Column:
    """A leaf's hash, over its range and its record's hash."""
    return F.sha2(F.concat_ws("|", F.lit("leaf"), offset.cast("string"), size.cast("string"), own), 256)


def leaves(records: DataFrame, own: Column | None = None) -> DataFrame:
    """file, place, offset, size and the leaf's hash: over the record's own hash (of content by default) and its range."""
    return records.select("file", "place", "offset", "size", leaf(F.col("offset"), F.col("size"), digest(F.col("content")) if own is None else own).alias("hash"))


def top_level(files: int, file_records: int = FILE_RECORDS) -> int:
    """The level of the archive's root, which stands over so many files."""
    levels = height(file_records)
    while files > 1:
        files, levels = -(-files // FANOUT), levels + 1
    return levels


def tree(leaf_rows: DataFrame, top: int, file_records: int = FILE_RECORDS) -> DataFrame:
    """level, node, first, end and hash of every node: leaves at 0, each level up one node for FANOUT children.

    Leaves are numbered through all files, each of which has FANOUT ** height places; so the nodes at the level
    of that height are the files' roots, and the only one at `top` is the archive's. A range is in bytes of the file up to
    a file's root, and in files above. Every level is written apart. No group has over FANOUT members.
    """
    spark, levels = leaf_rows.sparkSession, height(file_records)
    path = scratch_path(spark, "tree")
    node = F.col("file") * FANOUT**levels + F.col("place")
    level = leaf_rows.select(node.cast("long").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("size")).alias("end"), "hash")
    for k in range(top + 1):
        if k:
            below = spark.read.schema(level.schema).parquet(f"{path}/level={k - 1}")
            first, end = ("first", "end") if k != levels + 1 else ("node", F.col("node") + 1)
            up = below.groupBy(F.expr(f"node div {FANOUT}").alias("node")).agg(F.min(first).alias("first"), F.max(end).alias("end"), F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "hash"))).alias("below"))
            level = up.select("node", "first", "end", F.sha2(F.concat_ws("|", F.lit("node"), F.col("first").cast("string"), F.col("end").cast("string"), F.col("below.hash")), 256).alias("hash"))
        level.write.parquet(f"{path}/level={k}")
    return spark.read.schema("node long, first long, end long, hash string, level int").parquet(path)


def audit(one: DataFrame, two: DataFrame, top: int) -> DataFrame:
    """node and status of the leaves in which two trees of one height differ: changed, missing (in two) or extra (in two).

    From the archive's root down, only children of nodes that differ are compared, and a level's scan is narrowed to
    their span first; equal roots end the audit at once. The suspects of a level are written down before the next is read.
    """
    suspects, fields = None, "node long, a string, b string"
    for level in range(top, -1, -1):
        a, b = (t.where(F.col("level") == level).select("node", F.col("hash").alias(h)) for t, h in ((one, "a"), (two, "b")))
        if suspects is not None:
            span = suspects.agg(F.min("node"), F.max("node")).first()
            if span[0] is None:
                suspects = one.sparkSession.createDataFrame([], fields)
                break
            parents = suspects.select(F.col("node").alias("parent"))
            inside = F.col("node").between(span[0] * FANOUT, (span[1] + 1) * FANOUT - 1)
            a, b = (t.where(inside).withColumn("parent", F.expr(f"node div {FANOUT}")).join(parents, "parent", "left_semi").drop("parent") for t in (a, b))
        suspects = materialize(a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))), "suspects")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return suspects.select("node", status.alias("status"))


def drill(content: Column) -> Column:
    """What a replica with faults for drills has: of each 97 records about one begins with another byte and one lacks (null)."""
    hit = F.crc32(F.concat_ws("|", F.col("file").cast("string"), F.col("place").cast("string"))) % 97
    return F.when(hit != 14, F.when(hit == 13, F.concat(F.lit("X"), F.expr("substring(content, 2)"))).otherwise(content))


def drill_extra(records: DataFrame) -> DataFrame:
    """file, place, offset and size of the records that the drill's replica has more: one of a byte after each even file's last."""
    ends = records.where("file % 2 = 0").groupBy("file").agg(F.max("place").alias("last"), F.max(F.col("offset") + F.col("size")).alias("end"))
    return ends.select("file", (F.col("last") + 1).alias("place"), F.col("end").alias("offset"), F.lit(1).cast("long").alias("size"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in the first replica, with what the audit of a damaged second replica says of it.

    A row for each page and one, without page_id and leaf, for each extra record of the second replica. Both replicas'
    records are hashed where their bytes lie; only hashes and ranges go on to the trees. Null columns count as empty; an
    empty table gives no rows; repeated page_ids follow each other in any order, so which of them has which place is not
    fixed if they differ. Texts of any length are hashed whole. Other columns of pages are not read.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hashed = placed(pages).select("page_id", "file", "place", "size", digest(F.col("content")).alias("a"), digest(drill(F.col("content"))).alias("b"))
    records = materialize(with_offsets(hashed), "archive")
    files = (records.agg(F.max("file")).first()[0] or 0) + 1
    top, levels = top_level(files), height(FILE_RECORDS)
    extra = drill_extra(records)
    one = tree(leaves(records, F.col("a")), top)
    two = tree(leaves(records.where("b IS NOT NULL"), F.col("b")).unionByName(leaves(extra, digest(F.lit("X")))), top)
    room = FANOUT**levels
    found = audit(one, two, top).select(F.expr(f"node div {room}").alias("file"), (F.col("node") % room).alias("place"), "status")
    own = records.select("page_id", "file", "place", "offset", "size", leaf(F.col("offset"), F.col("size"), F.col("a")).alias("leaf"))
    more = extra.select(F.lit(None).cast("long").alias("page_id"), "file", "place", "offset", "size", F.lit(None).cast("string").alias("leaf"))
    roots = one.where(F.col("level") == levels).select(F.col("node").alias("file"), F.col("hash").alias("file_root"))
    archive_root = one.where(F.col("level") == top).select("hash").first()
    rows = own.unionByName(more).join(found, ["file", "place"], "left").join(roots, "file")
    return rows.select("page_id", "file", "place", "offset", "size", "leaf", F.coalesce("status", F.lit("intact")).alias("status"), "file_root", F.lit(archive_root and archive_root[0]).cast("string").alias("archive_root"))


#: Levels that the SQL below builds: enough for FANOUT ** 9 leaves.
_SQL_LEVELS = 9


def _sql() -> str:
    levels, room = height(FILE_RECORDS), FANOUT ** height(FILE_RECORDS)
    ups = []
    for k in range(1, _SQL_LEVELS + 1):
        first, end = ('min(first)', 'max("end")') if k != levels + 1 else ("min(node)", "max(node) + 1")
        ups.append(f"""l{k} AS (SELECT node // {FANOUT} AS node, {first} AS first, {end} AS "end", sha256('node|' || {first} || '|' || {end} || '|' || string_agg(hash, '|' ORDER BY node)) AS hash FROM l{k - 1} GROUP BY node // {FANOUT})""")
    tops = " UNION ALL ".join(f"SELECT {k} AS k, max(hash) AS hash FROM l{k} HAVING count(*) = 1" for k in range(levels, _SQL_LEVELS + 1))
    return f"""
WITH content AS (
  SELECT page_id, row_number() OVER (ORDER BY page_id NULLS FIRST) - 1 AS number,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS content
  FROM pages
), placed AS (
  SELECT page_id, number // {FILE_RECORDS} AS file, number % {FILE_RECORDS} AS place, strlen(content)::BIGINT AS size, content FROM content
), records AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM placed
), l0 AS (
  SELECT file, place, file * {room} + place AS node, "offset" AS first, "offset" + size AS "end", sha256('leaf|' || "offset" || '|' || size || '|' || sha256(content)) AS hash FROM records
), {", ".join(ups)}, tops AS ({tops}),
crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), faults AS (
  SELECT file, place, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(file || '|' || place)), lambda i: unicode(substr(file || '|' || place, i + 1, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 97 AS hit FROM records, crc_table
), rows_ AS (
  SELECT r.page_id, r.file, r.place, r."offset", r.size, l0.hash AS leaf, CASE hit WHEN 13 THEN 'changed' WHEN 14 THEN 'missing' ELSE 'intact' END AS status
  FROM records r JOIN l0 ON r.file = l0.file AND r.place = l0.place JOIN faults f ON r.file = f.file AND r.place = f.place
  UNION ALL SELECT NULL, file, max(place) + 1, max("offset" + size), 1, NULL, 'extra' FROM records WHERE file % 2 = 0 GROUP BY file
)
SELECT page_id, file::BIGINT AS file, place::BIGINT AS place, "offset"::BIGINT AS "offset", size::BIGINT AS size, leaf, status, l{levels}.hash AS file_root, (SELECT hash FROM tops ORDER BY k LIMIT 1) AS archive_root
FROM rows_ JOIN l{levels} ON file = l{levels}.node
"""


OP4_SQL = _sql()
