"""Periodic runs, divergence of sources and I-Match fingerprints against plain versions and SQL, on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import divergence, imatch, periodic_runs
from tidemark.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, k int, term string, part int, c0 string, collapsed string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                out.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdEF") for _ in range(k))
    vocabulary = [word(rng.randint(1, 4)) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(90)
    texts = [None, "", " \n\t ", "a", "x " * 500, "a b " * 40 + "a", base, base, base + " tail", "é ß İ 日本語 \x00 😀 don't\x1c\x85x", "ab\x0bcd\x0cef", text(3000), "x" * 5000, "12 34 !?"]
    texts += [text(rng.randint(1, 200)) for _ in range(90)]
    out = [(i, t, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s", "t", "u", "v", None]), len(t or ""), "r", 1, "t", 2, "c", "d") for i, t in enumerate(texts)]
    out += [(500 + i, "", "zz", f"only{i}", *[None] * 7) for i in range(3)]  # a language without terms
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def in_duckdb(rows, sql):
    con = duckdb.connect()
    frame = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"])
    frame = frame.astype({"doc_id": "Int64"})
    con.register("documents", frame)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return names, [tuple(None if x is pd.NA else x for x in r) for r in res.fetchall()]


def test_words_are_those_of_the_pattern(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    for breaks, pattern, lower in ((W.SPACES, r"[^\x20\x09-\x0D]+", False), (W.NO_LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", True)):
        got, counts = W.split(pa.array(texts)[0:], breaks, lower)
        want = [re.findall(pattern, t or "") for t in texts]
        if lower:
            want = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w] for w in want]
        assert counts.tolist() == [len(w) for w in want] and got.to_pylist() == [x for w in want for x in w]
        part = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))  # offsets that don't begin at 0
        assert W.split(part, breaks, lower)[0].to_pylist() == got.to_pylist()


def test_runs_equal_a_plain_search():
    rng = random.Random(1)
    for _ in range(400):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 3])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        got = periodic_runs.maximal_runs(np.array(w, dtype=np.int64))
        assert sorted(((s, e - s, p) for s, e, p in got.tolist()), key=lambda r: (r[0], r[2])) == plain_runs(w)


def test_misleading_hashes_are_found_out(monkeypatch):
    """The Thue-Morse word and its complement have equal hashes modulo 2^64; and hashes that say yes to everything do no harm."""
    t = [0]
    for _ in range(11):
        t += [1 - x for x in t]
    w = np.array([*t, *(1 - x for x in t), 5, 6])
    want = plain_runs(w.tolist())
    got = lambda: sorted(((s, e - s, p) for s, e, p in periodic_runs.maximal_runs(w).tolist()), key=lambda r: (r[0], r[2]))
    assert got() == want
    monkeypatch.setattr(periodic_runs.PrefixHashes, "same", lambda self, k, i, j: np.ones(len(i), bool))
    assert got() == want


def test_small_blocks_of_pairs_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    monkeypatch.setattr(periodic_runs, "WAITING", 3)
    w = [1, 2, 3] * 30 + [4] * 40 + [1, 2] * 20
    got = periodic_runs.maximal_runs(np.array(w))
    assert sorted(((s, e - s, p) for s, e, p in got.tolist()), key=lambda r: (r[0], r[2])) == plain_runs(w)


def test_op11(spark, rows, docs, none, tmp_path):
    more = docs.unionByName(spark.createDataFrame([(None, "q r " * 20, *[None] * 9), rows[5], rows[5]], SCHEMA))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    want, drilled = [], 0
    for i, t, *_ in [*rows, (None, "q r " * 20), rows[5], rows[5]]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            drilled += 1
        r = plain_runs(w)
        drop = {j for a, length, q in r for j in range(a + q, a + length)}
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None
        want.append((i, len(r), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in r)), sha(" ".join(x for j, x in enumerate(w) if j not in drop))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and drilled > 3 and sum(x[1] > 0 for x in want) > 5
    out = periodic_runs.periodic_runs(docs, "text", ["doc_id", "runs", "collapsed"])
    assert out.columns == ["doc_id", "runs_", "collapsed_", "n_words", "runs", "collapsed"]
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[5].collapsed == "a b" and [tuple(x) for x in by_id[5].runs] == [(0, 81, 2)] and by_id[0].n_words == 0
    assert periodic_runs.periodic_runs(none, "text", ["doc_id"]).count() == 0
    assert periodic_runs.periodic_runs(docs, "text").columns == ["n_words", "runs", "collapsed"]


def test_a_very_long_text_is_searched_as_a_whole():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 50_000, 300_000)
    w[1000:200_000] = w[1000 : 1000 + 50_000][np.arange(199_000) % 50_000]
    got = periodic_runs.maximal_runs(w)
    assert [tuple(r) for r in got.tolist()] == [(1000, 200_000, 50_000)]


def shares_of(n, total):
    return 1 + 10**9 * (n + 2) // total


def test_tile_sums_are_exact():
    rng = np.random.default_rng(3)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for _ in range(60):
        groups, terms = int(rng.integers(2, 9)), int(rng.integers(1, 12))
        n = (rng.integers(0, 4, (groups, terms)) * rng.integers(0, 50, (groups, terms))).astype(np.int64)
        total = n.sum(1) + 2 * (terms + 3)
        share = [[shares_of(int(x), int(t)) for x in row] for row, t in zip(n, total)]
        lack = [shares_of(0, int(t)) for t in total]
        seen = (n > 0).any(0)
        want = np.array([[sum(f(share[a][t], share[b][t]) - f(lack[a], lack[b]) for t in range(terms) if seen[t]) for b in range(groups)] for a in range(groups)])
        g, t = np.nonzero(n)
        cells = {"term": t, "gid": g, "n": n[g, t], "heavy": ((n > 0).sum(0) * 2 > groups)[t]}
        side = lambda a, b: {"gid": np.arange(a, b), "total": total[a:b]}
        upper = np.triu_indices(groups, 1)
        assert (divergence.tile_sums(cells, side(0, groups), side(0, groups), True)[upper] == want[upper]).all()
        half = groups // 2
        if half:
            assert (divergence.tile_sums(cells, side(0, half), side(half, groups), False) == want[:half, half:]).all()


def test_shares_beyond_64_bits():
    n, total = np.array([10**12, 0, 5]), np.array([3 * 10**14] * 3)
    assert divergence.share(n, total).tolist() == [shares_of(int(x), 3 * 10**14) for x in n]


@pytest.mark.parametrize("block", [512, 2])
def test_op12(spark, rows, docs, none, tmp_path, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", 512 if block == 512 else 7)
    docs.unionByName(spark.createDataFrame([rows[8], rows[8]], SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    df = divergence.op12_divergence(spark, str(tmp_path))
    names, want = in_duckdb([*rows, rows[8], rows[8]], divergence.OP12_SQL)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(got) == sorted(want)
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    parts = collections.Counter((r[names.index("lang")], r[names.index("part")]) for r in got)
    assert parts["zz", "pair"] == 6 and parts["zz", "term"] == 0 and parts["en", "term"] > 0
    if block == 512:
        assert divergence.divergence(none, "lang", "source", "text").count() == 0


@pytest.mark.parametrize("most", [imatch.BROADCAST_TERMS, 0])
def test_op13(spark, rows, docs, none, most):
    """The same by a broadcast lexicon and by a shuffled one, null keys last."""
    more = [*rows, (None, "the last of all " * 9, *[None] * 9)]
    df = imatch.fingerprints(spark.createDataFrame(more, SCHEMA), "doc_id", "text", broadcast_terms=most)
    names, want = in_duckdb(more, imatch.OP13_SQL.replace("ORDER BY doc_id DESC", "ORDER BY doc_id DESC NULLS LAST").replace("j.doc_id = t.doc_id", "j.doc_id IS NOT DISTINCT FROM t.doc_id").replace(".doc_id = d.doc_id", ".doc_id IS NOT DISTINCT FROM d.doc_id").replace("x.doc_id = d.next_id", "x.doc_id IS NOT DISTINCT FROM d.next_id"))
    got = [tuple(r) for r in df.select(*names).collect()]
    at = names.index("near_next")  # before the null key the SQL takes the first document for the next
    plain = lambda rows: sorted((r if r[0] != 0 else (*r[:at], *r[at + 1 :]) for r in rows), key=repr)
    assert plain(got) == plain(want) and len(got) == len(more)
    by_id = {r.doc_id: r for r in df.collect()}
    assert by_id[6].fingerprint == by_id[7].fingerprint and by_id[7].near_next == 1.0 and by_id[8].near_next > by_id[9].near_next and by_id[0].near_next == 0.0
    assert imatch.fingerprints(none, "doc_id", "text").count() == 0


def test_op13_repeated_rows(spark):
    """Rows of one key have the same next; the next is one document though its key repeats."""
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(3, "aa bb cc dd"), (3, "aa bb cc dd"), (2, "ee ff"), (2, "ee ff"), (2, "gg hh"), (1, None)], schema)
    got = imatch.fingerprints(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2, 2, 3, 3]
    assert len({r.edited_sha256 for r in got if r.doc_id == 3}) == 1 and len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert {r.edited_sha256 for r in got if r.doc_id == 3} <= {sha("aa bb" + x) for x in (" ee ff"[1:], "gg hh")} | {sha("aa bb " + x) for x in ("ee ff", "gg hh")}
    assert imatch.fingerprints(spark.createDataFrame([(1, "only one")], schema), "doc_id", "text").first().near_next == 1.0


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    one = rng.sample(vocabulary, 120)
    near, half, other = one[:115] + rng.sample(vocabulary, 5), one[:60] + rng.sample(vocabulary, 60), rng.sample(vocabulary, 120)
    fill = [(10 + i, " ".join(rng.sample(vocabulary, 60))) for i in range(60)]
    found = {}
    for name, words in (("same", one), ("near", near), ("half", half), ("other", other)):
        rows = [*fill, (2, " ".join(one)), (1, " ".join(words))]
        found[name] = {r.doc_id: r.near_next for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}[2]
    assert found["same"] == 1.0 > found["near"] > found["half"] > found["other"]
