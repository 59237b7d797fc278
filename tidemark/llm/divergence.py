"""Divergence of sources: how far the terms of the sources of one language lie apart, exactly, in whole numbers.

Each group (language, source) gives each kept term of its language a smoothed share. A pair of groups differs by a sum
over all kept terms. Terms that over half the groups of the language have (heavy) are rows of dense tiles, for which numpy
sums all pairs at once. Of the others (light) most groups have none, and a group's share of what it lacks is one number; so their
sum is that of two groups that lack them all, plus for each group a correction by what it has alone, plus a correction for each
pair that a posting holds. Both partial sums are whole numbers and are added without error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.words import NO_LETTERS, groups, numbered, split

#: A language keeps the terms that so many of its documents have.
LEAST_DOCS = 10
#: Ranks of the terms of a group that are reported.
TOP = 10
#: Terms in a tile, on average.
TILE = 512
#: Groups on one side of a tile; more of a language make several blocks.
BLOCK = 512
#: Shares are in units of one in so many.
UNIT = 1_000_000_000
#: Numbers that a step of a tile works on at a time.
STEP = 1 << 20

#: How far shares p and q lie apart.
DIVERGENCE = "(p - q) * (p - q) div (p + q)"


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total), by long division in steps of 1000, so that nothing overflows below 9e15."""
    rest, out = count + 2, np.zeros_like(count)
    whole, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return whole * UNIT + out + 1


def _share(count: str, total: str) -> str:
    """The same in SQL, in decimals."""
    return f"cast(1 + {UNIT}BD * ({count} + 2) div {total} AS bigint)"


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def term_counts(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it); for each group a row with a null term as well.

    Nulls count as ''. Texts of any length are read whole. Counts are summed for 4 MB of text, then for each task, before
    they are shuffled, so that a source with a third of all rows sends its terms once a task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text"):
                words, counts = split(part["text"], NO_LETTERS, lower=True)
                ids, listed = numbered(words)
                langs, sources = (part[c].dictionary_encode() for c in ("lang", "source"))
                width, many = max(1, len(listed)), max(1, len(sources.dictionary))
                own = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + sources.indices.to_numpy(zero_copy_only=False)
                pairs, n = np.unique(np.repeat(np.arange(len(counts)), counts) * width + ids, return_counts=True)
                keys, place, docs = np.unique(own[pairs // width] * width + pairs % width, return_inverse=True, return_counts=True)
                n = np.bincount(place, n, len(keys)).astype(np.int64)
                met = np.unique(own)
                group = np.concatenate([met, keys // width])
                terms = pa.concat_arrays([pa.nulls(len(met), pa.string()), listed.take(pa.array(keys % width)).cast(pa.string())])
                zeros = np.zeros(len(met), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(group // many)), sources.dictionary.take(pa.array(group % many)), terms, pa.array(np.append(zeros, n)), pa.array(np.append(zeros, docs))],
                    ["lang", "source", "term", "n", "docs"],
                )

    put = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    rows = put.mapInArrow(work, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tile_sums(cells: dict[str, np.ndarray], first: dict[str, np.ndarray], second: dict[str, np.ndarray], one_block: bool) -> np.ndarray:
    """For each group of `first` (rows) and each of `second` (columns) the sum over the terms of one tile that have a cell here, less what it were if both groups lacked them all.

    cells: term, gid, n and heavy of every cell with a count, all numpy arrays; first, second: gid (ascending) and total of the
    groups. Of one block with itself only pairs with the row before the column count.
    """
    f0, s0 = share(np.zeros_like(first["gid"]), first["total"]), share(np.zeros_like(second["gid"]), second["total"])
    out = np.zeros((len(f0), len(s0)), np.int64)
    order = np.lexsort((cells["gid"], cells["term"]))
    term, gid, n, heavy = (cells[c][order] for c in ("term", "gid", "n", "heavy"))
    sides = []
    for side in (first, second):
        at = np.minimum(np.searchsorted(side["gid"], gid), len(side["gid"]) - 1)
        sides.append((side["gid"][at] == gid, at, share(n, side["total"][at])))
    (in_first, at_first, p), (in_second, at_second, q) = sides

    names, place = np.unique(term[heavy], return_inverse=True)
    width = max(1, STEP // max(1, len(s0)))
    for at in range(0, len(names), width):
        size = min(width, len(names) - at)
        a, b = np.tile(f0, (size, 1)), np.tile(s0, (size, 1))
        for own, inside, col, values in ((a, in_first, at_first, p), (b, in_second, at_second, q)):
            mine = inside[heavy] & (place >= at) & (place < at + size)
            own[place[mine] - at, col[heavy][mine]] = values[heavy][mine]
        for row in range(len(f0)):
            out[row] += distance(a[:, row : row + 1], b).sum(0)
    base = distance(f0[:, None], s0[None, :])
    out -= base * len(names)

    light = ~heavy
    for inside, col, values, other, turn in ((in_first, at_first, p, s0, False), (in_second, at_second, q, f0, True)):
        mine = np.flatnonzero(inside & light)
        kinds, times = np.unique(np.stack([col[mine], values[mine]], 1), axis=0, return_counts=True)  # equal shares of a group count together
        for at in range(0, len(kinds), max(1, STEP // len(other))):
            k, m = kinds[at : at + max(1, STEP // len(other))], times[at : at + max(1, STEP // len(other)), None]
            change = (distance(k[:, 1:], other[None, :]) - (base.T if turn else base)[k[:, 0]]) * m
            np.add.at(out.T if turn else out, k[:, 0], change)

    rows = np.flatnonzero(in_first & light)
    ends = np.searchsorted(term, term[rows], "right")
    begins = rows + 1
    if not one_block:  # the second block's cells of a term stand behind those of the first
        behind = np.append(np.cumsum(in_second[::-1])[::-1], 0)
        begins = ends - (behind[np.minimum(rows, len(term))] - behind[ends])
    sizes = np.maximum(ends - begins, 0)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, STEP + (upto[at - 1] if at else 0), "right")))
        z = sizes[at:to]
        i = np.repeat(rows[at:to], z)
        j = np.arange(z.sum()) + np.repeat(begins[at:to] - np.cumsum(z) + z, z)
        a, b = at_first[i], at_second[j]
        change = distance(p[i], q[j]) - distance(p[i], s0[b]) - distance(f0[a], q[j]) + base[a, b]
        np.add.at(out, (a, b), change)
        at = to
    return out


def _pair_sums(cells: DataFrame, members: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, a, b (numbers of groups, a < b) and value: what tile_sums gives, over all kept terms, tile by tile, block pair by block pair."""
    blocks = langs.select("lang", F.expr(f"greatest(1, cast(ceil(terms / {TILE}) AS int))").alias("tiles"), F.expr(f"cast(ceil(groups / {BLOCK}) AS int)").alias("blocks"))
    block = F.expr(f"gid div {BLOCK}").cast("int")
    with_blocks = F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, b) AS i, greatest(o, b) AS j))")).alias("ij")
    put = cells.join(blocks, "lang").select("lang", F.expr("cast(pmod(xxhash64(term), tiles) AS int)").alias("tile"), "term", "gid", "n", "heavy", block.alias("b"), "blocks")
    put = put.select("lang", "tile", with_blocks, "term", "gid", "n", "heavy").select("lang", "tile", "ij.i", "ij.j", "term", "gid", "n", "heavy")
    sides = members.join(blocks, "lang").select("lang", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), "gid", "total", block.alias("b"), "blocks")
    sides = sides.select("lang", "tile", with_blocks, "gid", "total").select("lang", "tile", "ij.i", "ij.j", "gid", "total")

    def work(key: tuple, cells: pa.Table, sides: pa.Table) -> pa.Table:
        lang, _, i, j = (x.as_py() for x in key)
        kind = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])
        if not len(cells):
            return kind.empty_table()
        numbers = {c: cells[c].to_numpy().astype(np.int64) for c in ("gid", "n")}
        numbers["term"] = pc.dictionary_encode(cells["term"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers["heavy"] = cells["heavy"].to_numpy().astype(bool)
        gid, total = sides["gid"].to_numpy().astype(np.int64), sides["total"].to_numpy().astype(np.int64)
        order = np.argsort(gid)
        halves = [{"gid": gid[o], "total": total[o]} for o in (order[gid[order] // BLOCK == k] for k in (i, j))]
        sums = tile_sums(numbers, *halves, i == j)
        a, b = np.nonzero(halves[0]["gid"][:, None] < halves[1]["gid"][None, :])
        return pa.table([pa.array([lang] * len(a), pa.string()), halves[0]["gid"][a], halves[1]["gid"][b], sums[a, b]], schema=kind)

    keys = ("lang", "tile", "i", "j")
    parts = put.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(work, "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(df: DataFrame, lang: str, source: str, text: str, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how far each group lies from the others of its language, and by which terms.

    Part `pair` has each other source of the language, all ranks; part `term` the `top` terms that the group uses more than its
    language does. Every group that occurs is there, one without terms too; a language without kept terms gives pairs of value 0.
    Nulls count as ''; repeated rows count each time; other columns are not read; an empty table gives no rows. What one task holds
    is a tile of terms over two blocks of groups; a term's posting has a cell a source at most.
    """
    counts = materialize(term_counts(df, lang, source, text), "termcounts")
    found = counts.groupBy("lang", "source").agg(F.lit(1).alias("one"))
    numbers = Window.partitionBy("lang").orderBy("source")
    named = materialize(found.select("lang", "source", (F.row_number().over(numbers) - 1).cast("long").alias("gid")), "groups")
    wide = named.groupBy("lang").agg(F.count("*").alias("groups"))
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.count("*").alias("holders"))
    kept = materialize(kept.where(F.col("docs") >= least_docs).join(wide, "lang").select("lang", "term", "n_lang", F.expr("2 * holders > groups").alias("heavy")), "keptterms")
    langs = wide.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("n")), "lang", "left").na.fill(0)
    langs = materialize(langs.select("lang", "groups", "terms", (F.col("n") + 2 * F.col("terms")).alias("lang_total")), "languages")
    cells = materialize(counts.join(kept, ["lang", "term"]).join(named, ["lang", "source"]).select("lang", "source", "gid", "term", "n", "n_lang", "heavy"), "cells")
    totals = cells.groupBy("lang", "gid").agg(F.sum("n").alias("n"))
    members = named.join(totals, ["lang", "gid"], "left").join(langs, "lang")
    members = members.select("lang", "source", "gid", (F.coalesce("n", F.lit(0)) + 2 * F.col("terms")).alias("total"), "lang_total", "terms")
    members = materialize(members.withColumn("p", F.expr(f"if(terms = 0, null, {_share('0', 'total')})")), "members")

    sums = _pair_sums(cells.select("lang", "term", "gid", "n", "heavy"), members.where("total > 0").select("lang", "gid", "total"), langs)
    one, two = members.select("lang", "source", "gid", "terms", "p"), members.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"), F.col("p").alias("q"))
    pairs = one.join(two, "lang").where("gid <> other").withColumns({"a": F.least("gid", "other"), "b": F.greatest("gid", "other"), "lacking": F.coalesce(F.expr(f"terms * ({DIVERGENCE})"), F.lit(0))})
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("lacking") + F.coalesce("value", F.lit(0))).alias("value"))
    shares = cells.join(members.drop("source", "terms", "p"), ["lang", "gid"])
    shares = shares.select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "total")).alias("p"), F.expr(_share("n_lang", "lang_total")).alias("q"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr(DIVERGENCE).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages of documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "source", "text")


OP12_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, (1 + {UNIT} * (n + 2)::HUGEINT // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p FROM grid
), whole AS (
  SELECT lang, term, (1 + {UNIT} * (n + 2)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)))::BIGINT AS q
  FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM grid GROUP BY ALL)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, ((s.p - w.q) * (s.p - w.q) // (s.p + w.q))::BIGINT FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q
)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP}
"""
