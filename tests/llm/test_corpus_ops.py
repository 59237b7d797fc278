"""Corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe_trie, decontaminate, hmm, kneser_ney, licenses, quality_rules, sharding, simhash, token_store, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids binary, c0 string, __fp string, tie int, __items int, __failed int, rid int"


def words(rng, n, letters="abcdef"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))][0]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [None, "", " \n\t ", "a", "A a A a", base, base, base + " tail", base.upper(), "x" * 5000, words(rng, 3000), "é ß İ 日本語 😀 don't", "<|endoftext|> hi <|ENDOFTEXT|>", "\x1c\x1d\x85\xa0 z"]
    texts += [words(rng, rng.randint(1, 90), rng.choice(["abcdef", "ghijkl"])) for _ in range(40)]
    out = [(i, t, rng.choice(["en", "de", None]), "s", len(t or ""), 1, b"", "c", "f", 2, 3, 4, 5) for i, t in enumerate(texts)]
    out += [out[5], out[5], out[9]]  # repeated rows
    out += [(None, base, *[None] * 11), (None, None, "en", *[None] * 10)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_law(spark, docs, none, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op1_sharding(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, sharding.SHARDS) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got)
    assert sharding.shard_rows(none.select("doc_id"), "doc_id", [1.0, 2.0]).count() == 0
    named = sharding.shard_rows(spark.range(5).selectExpr("id AS row", "id * 2 AS part", "'u' || id AS slot"), "row", [1.0] * 3, keep=["part", "slot"])
    assert named.columns == ["row", "part", "slot_", "shard", "grown_shard", "slot"] and sorted(map(tuple, named.select("row", "part", "slot_").collect())) == [(i, 2 * i, f"u{i}") for i in range(5)]


def test_sharding_weights_and_growth(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    out = sharding.shard_rows(df, "doc_id", [1.0, 3.0, 0.0], [1.0, 3.0, 0.0, 4.0]).collect()
    n = collections.Counter(r.shard for r in out)
    assert n[2] == 0 and abs(n[1] / n[0] - 3) < 0.25
    moved = [r for r in out if r.grown_shard != r.shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / 20000 - 0.5) < 0.03


def test_hot_key_gets_gapless_slots(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id")
    out = sharding.shard_rows(df, "doc_id", [1.0] * 3).collect()
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licenses(spark, docs, none):
    cases = {MIT: "MIT", "Foo bar.\nLicensed under the Apache License, Version 2.0.": "Apache-2.0", "Some licensed software": "", "licensed under cc by-nc 4.0": "CC-BY-NC-4.0", "Released under the MIT License. Licensed under CC BY 4.0.": "CC-BY-4.0,MIT"}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, licenses string")
    got = {r[0]: r for r in licenses.scan(df.drop("licenses")).collect()}
    assert [got[i].licenses for i in range(len(cases))] == list(cases.values())
    assert "mit-text" in got[0].rules.split(",") and "mit-grant1" not in got[0].rules
    assert licenses.scan(docs).where("licenses = ''").count() == docs.count()
    assert licenses.scan(none).count() == 0


def plain_measure(text):
    t = (text or "").encode()
    w = t.split()
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(win)
    covered = {i + d for i, x in enumerate(win) if c[x] > 1 for d in range(3)}
    lines = [x for x in t.split(b"\n") if x.split()]
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, docs, none, rows):
    for t in [r[1] for r in rows] + ["a b c a b c a b", "x x x x", "l\nl\n\nm\r\nm\r\n", "a#b <|> c"]:
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(t and t.encode())))
        assert tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_measure(t)
    led = quality_rules.ledger(docs)
    assert led.count() == docs.count() and {"tie", "__failed_" if "__failed" in docs.columns else "tie"} <= set(led.columns)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    full = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(led, "v2").collect()}
    names = list(quality_rules.RULES)
    bits = [r["__failed"] for r in led.collect()]
    for rule in quality_rules.POLICIES["v2"]:
        b, m = 1 << names.index(rule), quality_rules.mask("v2")
        assert full[rule] == (sum(bool(x & b) for x in bits), sum(x & m == b for x in bits))
    assert quality_rules.keep_good(none).count() == 0


def test_warc_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "y" * (i % 50)) for i in range(300)] + [(None, None, None), (5, "http://x/5", "<p>yyyyy"), (5, "http://x/5", "<p>yyyyy")], "page_id long, url string, html string")
    rec = warc.archive(pages, 64).cache()
    got = sorted(rec.collect(), key=lambda r: (r.file, r.place))
    at = 0
    for i, r in enumerate(got):
        assert (r.file, r.place) == (i // 64, i % 64)
        at = 0 if r.place == 0 else at
        assert r.offset == at and r.size == len(r.content.encode())
        at += r.size
    top = warc.top_level(5, 64)
    assert (warc.height(64), top) == (2, 3)
    one = warc.tree(warc.leaves(rec), top, 64).cache()
    assert one.where("level = 2").count() == 5 and one.where("level = 3").count() == 1
    bad = rec.where("NOT (file = 4 AND place = 46)").selectExpr("page_id", "file", "place", "offset", "size", "CASE WHEN file = 2 AND place IN (0, 33) THEN 'z' ELSE content END AS content")
    more = rec.where("file = 3 AND place = 63").selectExpr("page_id", "file", "64L AS place", "offset + size AS offset", "size", "content")
    two = warc.tree(warc.leaves(bad.unionByName(more)), top, 64)
    assert sorted(map(tuple, warc.audit(one, two, top).collect())) == [(512, "changed"), (545, "changed"), (832, "extra"), (1070, "missing")]
    assert warc.audit(one, one, top).count() == 0
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_root_by_hand(spark):
    """A tree of two files against hashlib."""
    sha = lambda *x: hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()
    pages = spark.createDataFrame([(i, "u", "b" * i) for i in range(20)], "page_id long, url string, html string")
    rec = sorted(warc.archive(pages, 16).collect(), key=lambda r: (r.file, r.place))
    leaf_ = [sha("leaf", r.offset, r.size, hashlib.sha256(r.content.encode()).hexdigest()) for r in rec]
    ends = [r.offset + r.size for r in rec]
    files = [sha("node", 0, ends[15], *leaf_[:16]), sha("node", 0, ends[19], *leaf_[16:])]
    top = warc.top_level(2, 16)
    got = warc.tree(warc.leaves(warc.archive(pages, 16)), top, 16)
    assert [r.hash for r in got.where("level = 1").orderBy("node").collect()] == files
    assert [r.hash for r in got.where(f"level = {top}").collect()] == [sha("node", 0, 2, *files)]


def test_warc_empty_and_null_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/a/pages.parquet")
    assert warc.op4_warc(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(None, None, None), (None, "u", None), (3, None, "x" * 300_000), (3, None, "y")], "page_id long, url string, html string").selectExpr("*", "1 AS file", "2 AS hash").write.parquet(f"{tmp_path}/b/pages.parquet")
    got = warc.op4_warc(spark, f"{tmp_path}/b").collect()
    assert len(got) == 5 and [r.status for r in got if r.leaf is None] == ["extra"] and len({r.archive_root for r in got}) == 1


def distance(a, b):
    c, st = np.zeros(len(b) + 1, int), np.arange(len(b) + 1)
    for x in a:
        n = np.empty_like(c)
        n[0] = c[0] + 1
        n[1:] = np.minimum(c[:-1] + (b != x), c[1:] + 1)
        c = np.minimum.accumulate(n - st) + st
    return c.min()


def test_decontamination_against_full_alignment(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, words(rng, rng.randint(1, 30))) for i in range(40)] + [(40, None), (41, "..."), (42, "ab"), (None, "abc def ghi")]
    texts = []
    for i, t in items[:40]:
        y = list(t)
        for _ in range(rng.randrange(0, len(y) // 8 + 2)):
            p, k = rng.randrange(len(y)), rng.choice("sid")
            if k == "s":
                y[p] = rng.choice("xyz")
            elif k == "i":
                y.insert(p, rng.choice("xyz"))
            elif len(y) > 1:
                del y[p]
        texts.append(words(rng, rng.randint(0, 60)) + " " + "".join(y) + " " + words(rng, rng.randint(0, 60)))
    texts += [None, "", "ab", "cab", "x " * 4000 + items[0][1].upper()]
    ix = decontaminate.index([x for x in items if x[0] is not None])
    want = []
    for t in texts:
        codes, hits = decontaminate.normalise(t or ""), []
        for i, x in items:
            it = decontaminate.normalise(x or "")
            if i is None or not len(it):
                continue
            if len(it) < decontaminate.Q:
                ok = (" " + "".join(chr(c) if c else " " for c in it) + " ") in (" " + "".join(chr(c) if c else " " for c in codes) + " ")
            else:
                ok = distance(it, codes) <= decontaminate.budget(len(it))
            if ok:
                hits.append(i)
        want.append(sorted(hits))
    assert [decontaminate.matches(t, ix) for t in texts] == want and any(want)
    docs = spark.createDataFrame([(i, t, "n", 7) for i, t in enumerate(texts)], "doc_id long, text string, c0 string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        numbered, met = decontaminate.contamination(docs, bench)
        got = {r.c0: r["items"] or [] for r in numbered.join(met, "rid", "left").select("c0", "items").collect()}
        return [got[i] for i in range(len(texts))]

    assert found() == want
    monkeypatch.setattr(decontaminate, "POSTINGS", 3)
    assert [decontaminate.matches(t, ix) for t in texts] == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert len(list(decontaminate.blocks(bench))) > 2 and found() == want
    unnamed = decontaminate.index([(1, "abc def ghi")])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w and not decontaminate.matches(t, unnamed) for w, t in zip(want, texts))
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def plain_fingerprint(t, k):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance_):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance_:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(len(fps))]


@pytest.mark.parametrize("piece", [4096, 3])
def test_simhash(docs, none, piece):
    got = simhash.near_duplicates(docs, piece=piece).collect()
    rows = docs.collect()
    fps = [plain_fingerprint(r.text, 4) for r in rows]
    comp = brute_components([r.doc_id for r in rows], fps, 4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got], key=key) == sorted(zip([r.doc_id for r in rows], fps, comp), key=key)
    assert simhash.near_duplicates(none).count() == 0


def dense(seed):
    """Random fingerprints, some of them in clusters of close ones."""
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in list(fps)[:4]:
        for _ in range(150):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    return sorted(fps)


def roots_of(edges, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("run", [simhash.RUN, 0])
def test_simhash_links_in_dense_clusters(spark, run, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", run)  # at 0 the keys are as long as they get
    fps = dense(8)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").selectExpr("fp AS node", "fp")
    want = brute_components(list(range(len(fps))), fps, 4)
    for piece in (4096, 16) if run else (4096,):
        edges = [(fps.index(u & (1 << 64) - 1), fps.index(v & (1 << 64) - 1)) for u, v in simhash.links(df, 4, piece).collect()]
        assert roots_of(edges, len(fps)) == want


def test_simhash_tree_finds_all_pairs_and_prunes():
    fps = np.array(dense(9), np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    cut = 400
    tally = collections.Counter()
    one = simhash.Tree(fps, np.array([0]))
    got = {p for i, j in one.pairs(np.array([0]), np.array([0]), 4, tally) for p in zip(i.tolist(), j.tolist())}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == {(i, j) for i, j in zip(*np.nonzero(apart <= 4)) if i < j}
    assert len({level for level, _ in tally}) >= 3 and all(tally[level, "left"] < tally[level, "met"] for level in (0, 1, 2))
    two = simhash.Tree(fps, np.array([0, cut]))
    got = {p for i, j in two.pairs(np.array([0]), np.array([1]), 4) for p in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for i, j in zip(*np.nonzero(apart <= 4)) if i < cut <= j}


@pytest.mark.parametrize("piece", [4096, 3])
def test_keep_one(docs, none, piece):
    """Against plain links: word bits and shingle bits of all pairs."""
    kept = simhash.keep_one(docs, piece)
    assert kept.columns == docs.columns
    rows = docs.collect()
    marks = [simhash.sketch(r.text and r.text.encode()) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i][0] ^ marks[j][0]).bit_count() <= simhash.WORD_BITS and sum((a ^ b).bit_count() for a, b in zip(marks[i][1:], marks[j][1:])) <= simhash.SHINGLE_BITS]
    groups = collections.defaultdict(list)
    for i, root in enumerate(roots_of(edges, len(rows))):
        groups[root].append((rows[i].doc_id is None, rows[i].doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(map(min, groups.values()))
    assert simhash.keep_one(none).count() == 0


def test_keep_one_follows_the_shingles(spark):
    """Nine in ten copies of a similarity of 0.9 go, half copies all stay."""
    rng = random.Random(12)
    vocab = [words(rng, 1, "abcdefghij") for _ in range(3000)]
    out, copies = [], set()
    for k in range(60):
        text = [rng.choice(vocab) for _ in range(200)]
        near, half = list(text), [w if i < 110 else rng.choice(vocab) for i, w in enumerate(text)]
        for at in rng.sample(range(5, 195), 2):
            near[at] = rng.choice(vocab)
        out += [(3 * k, " ".join(text)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(half))]
        copies.add(3 * k + 1)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert len(kept & copies) <= 6 and len(kept - copies) == 120


def test_sketch_of_words_and_shingles():
    text = " ".join(words(random.Random(1), 90).split()) + " A a A b"
    parts = text.lower().split()
    count = collections.Counter(parts)
    weights = {w: round(1024 * math.sqrt(n)) for w, n in count.items()}
    half = sum(weights.values())
    want = sum(1 << b for b in range(64) if 2 * sum(n for w, n in weights.items() if xxhash.xxh64_intdigest(w, 42) >> b & 1) > half)
    assert simhash.sketch(text.encode())[0] == want
    assert simhash.sketch(b"x y")[1:] == simhash.sketch(b"X  y\n")[1:] and simhash.sketch(None) == (0,) * 5


def test_bpe_matches_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    path = bpe_trie.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id or -1, hashlib.sha256(np.array(e := lib.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()) for r in rows)
    assert want == sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256) for r in bpe_trie.digest_docs(docs, path).collect())
    out = bpe_trie.encode_docs(docs.withColumn("copy", F.col("text")), path)
    assert "ids_" in out.columns and out.count() == docs.count()
    assert {r.doc_id for r in out.where("decoded <> coalesce(copy, '')").collect()} <= {r.doc_id for r in rows if lib.decode(lib.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) != (r.text or "")}
    assert bpe_trie.encode_docs(none, path).count() == 0


def test_dac_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        for hi in (200, 300, 49408, 1 << 40):
            a = rng.integers(0, hi, n).astype(np.uint64)
            r = token_store.DacReader(token_store.dac_encode(a))
            assert len(r) == n and (r.read(0, n) == a).all()
            for i in rng.integers(0, max(n, 1), 15) if n else ():
                j = int(rng.integers(i, n + 1))
                assert r[int(i)] == a[i] and (r.read(int(i), j) == a[i:j]).all()
    with pytest.raises(ValueError):
        token_store.DacReader(b"nope")


def test_token_store(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    token_store.write_store(docs, path, f"{tmp_path}/s", segment_tokens=500)
    got = token_store.read_docs(spark, f"{tmp_path}/s").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = collections.Counter((r.doc_id, zlib.crc32(np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in docs.collect())
    assert want == collections.Counter((r.doc_id, r.ids_crc32) for r in got)
    token_store.write_store(none, path, f"{tmp_path}/e")
    assert token_store.read_docs(spark, f"{tmp_path}/e").count() == 0


def test_forward_and_expected_counts_by_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    k, m = hmm.STATES, hmm.CLASSES
    old = hmm.STATES
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k))
    seqs = [rng.integers(0, m, n) for n in (1, 3, 2, 3)]
    order = sorted(range(4), key=lambda i: -len(seqs[i]))
    got = hmm.forward([seqs[i] for i in order], model)[0]
    start, move, total = np.zeros(k), np.zeros((k, k)), []
    for s in (seqs[i] for i in order):
        p_all = 0.0
        st, mv = np.zeros(k), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[b, x]
            p_all += p
            st[path[0]] += p
            for a, b in zip(path, path[1:]):
                mv[a, b] += p
        start, move = start + st / p_all, move + mv / p_all
        total.append(math.log10(p_all))
    assert np.allclose(got, total)
    flat = hmm.expected(seqs, model)
    assert np.allclose(flat[:k], start) and np.allclose(flat[k : k * (k + 1)].reshape(k, k), move)
    assert np.isclose(flat[k * (k + 1) :].sum(), sum(map(len, seqs))) and hmm.STATES == old


def plain_hmm(texts, share):
    """The whole model from the rule, a sequence at a time: word classes, Baum-Welch by shares and rounds, and scores."""
    k, count = hmm.STATES, collections.Counter(w for _, out, words_ in texts if not out for w in words_)
    vocab = {w for _, _, words_ in texts for w in words_}
    top = {w: i for i, w in enumerate(sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], w))[: hmm.FREQUENT])}
    cls = {w: top.get(w, hmm.FREQUENT + zlib.crc32(w.decode("utf-8", "replace")[-hmm.SUFFIX :].encode()) % hmm.HASHED) for w in vocab}
    n_in, v_in = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in count.items():
        n_in[cls[w]] += n
        v_in[cls[w]] += 1
    shares = n_in.copy()
    shares[hmm.END] = sum(not out for _, out, _ in texts)
    shares = (shares + hmm.SMOOTH) / (shares.sum() + hmm.SMOOTH * hmm.CLASSES)
    seqs = [[cls[w] for w in words_] + [hmm.END] for _, _, words_ in texts]

    def passes(seq, m):
        """Scaled forward shares, their scales and backward values, one step at a time."""
        f, scale = np.zeros((len(seq), k)), np.zeros(len(seq))
        for t, x in enumerate(seq):
            now = (m.start if t == 0 else f[t - 1] @ m.move) * m.emit[:, x]
            scale[t] = now.sum()
            f[t] = now / scale[t]
        b = np.ones((len(seq), k))
        for t in range(len(seq) - 2, -1, -1):
            b[t] = m.move @ (m.emit[:, seq[t + 1]] * b[t + 1]) / scale[t + 1]
        return f, scale, b

    model = hmm.Model.first(shares)
    learn = [(share[i, len(words_) + 1], seq) for (i, out, words_), seq in zip(texts, seqs) if not out]
    for step in [*range(hmm.SHARES)] * hmm.SWEEPS + [None] * hmm.ROUNDS:
        some = [seq for s, seq in learn if step is None or s == step]
        if not some:
            continue
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, hmm.CLASSES))
        for seq in some:
            f, scale, b = passes(seq, model)
            start += f[0] * b[0]
            for t, x in enumerate(seq):
                emit[:, x] += f[t] * b[t]
                if t:
                    move += np.outer(f[t - 1], model.emit[:, x] * b[t]) * model.move / scale[t]
        model = hmm.Model.of_counts(np.concatenate([start, move.ravel(), emit.ravel()]), shares)
    inside = {w: 0.0 if cls[w] < hmm.FREQUENT else math.log10((count[w] + hmm.SMOOTH) / (n_in[cls[w]] + hmm.SMOOTH * (v_in[cls[w]] + 1))) for w in vocab}
    return [sum(inside[w] for w in words_) + float(np.log10(passes(seq, model)[1]).sum()) for (_, _, words_), seq in zip(texts, seqs)]


def test_hmm_scores(spark, docs, none):
    got = hmm.score(docs).collect()
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter()
    for r in rows:
        if not held(r.doc_id):
            c.update((r.text or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = (r.text or "").encode().lower().split() + [None]
        want.append((r.doc_id is None, r.doc_id or 0, held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted(want) == sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    share = {(r.d, r.n): r.s for r in spark.createDataFrame([(r.doc_id, len((r.text or "").encode().split()) + 1) for r in rows], "d long, n long").selectExpr("d", "n", f"pmod(xxhash64(d, n), {hmm.SHARES}L) AS s").collect()}
    want = plain_hmm([(r.doc_id, held(r.doc_id), (r.text or "").encode().lower().split()) for r in rows], share)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 5)) for r in got) == sorted((i is None, i or 0, len(w) + 1, round(s, 5)) for (i, _, w), s in zip([(r.doc_id, 0, (r.text or "").encode().split()) for r in rows], want))
    assert hmm.score(none).count() == 0


def plain_kn(train, asked):
    """Interpolated modified Kneser-Ney by dictionaries; texts are symbol lists."""
    order = kneser_ney.ORDER
    counts = collections.Counter()
    for s in train:
        p = [0] * (order - 1) + list(s)
        counts.update(tuple(p[i : i + order]) for i in range(len(s)))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    stats = {}
    for k, t in tables.items():
        n = [0] + [sum(1 for x in t.values() if x == j) for j in (1, 2, 3, 4)]
        d = [0.0]
        for j in (1, 2, 3):
            x = j - (j + 1) * n[1] / (n[1] + 2 * n[2]) * n[j + 1] / n[j] if n[1] and n[j] else -1
            d.append(x if 0 < x < j else j / 2)
        ctx = collections.defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            ctx[g[:-1]][0] += c
            ctx[g[:-1]][1] += d[min(c, 3)]
        stats[k] = (t, d, ctx)

    def p(g):
        if not g:
            return 1 / kneser_ney.SYMBOLS
        t, d, ctx = stats[len(g)]
        low = p(g[1:])
        if g[:-1] not in ctx:
            return low
        total, mass = ctx[g[:-1]]
        c = t.get(g, 0)
        return ((c - d[min(c, 3)]) if c else 0.0) / total + mass / total * low

    out = []
    for s in asked:
        q = [0] * (order - 1) + list(s)
        out.append(-sum(math.log(p(tuple(q[i : i + order]))) for i in range(len(s))) / len(s) if len(s) else None)
    return out


def plain_thresholds(rows, calibrating):
    """The threshold of each row from the rule: medians and quantiles of lists, blended by their numbers."""
    quantile = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
    read = [r for r in rows if r.log_ppl is not None]
    sure = [r for r in read if r.c0 in calibrating]
    centre, own = {}, collections.Counter(r.lang for r in sure)
    for lang in {r.lang for r in read}:
        usual = quantile([r.log_ppl for r in read if r.lang == lang], 0.5)
        middle = quantile([r.log_ppl for r in sure if r.lang == lang], 0.5) if own[lang] else 0.0
        centre[lang] = (own[lang] * middle + kneser_ney.CENTRE_WEIGHT * usual) / (own[lang] + kneser_ney.CENTRE_WEIGHT)
    over = lambda rs: [(r.log_ppl - centre[r.lang]) * math.sqrt(r.n_symbols) for r in rs]
    pooled = quantile(over(sure or read), kneser_ney.HIGH) if read else None
    fence = {}
    for lang in centre:
        q = quantile(over([r for r in sure if r.lang == lang]), kneser_ney.HIGH) if own[lang] else 0.0
        fence[lang] = (own[lang] * q + kneser_ney.FENCE_WEIGHT * pooled) / (own[lang] + kneser_ney.FENCE_WEIGHT)
    return [None if r.log_ppl is None else centre[r.lang] + fence[r.lang] / math.sqrt(r.n_symbols) for r in rows]


@pytest.mark.parametrize("table_rows", [kneser_ney.TABLE_ROWS, 0])
def test_kneser_ney(spark, docs, none, table_rows, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TABLE_ROWS", table_rows)
    rows = [r for r in docs.collect()]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5, 40)] + [(7, 0, 0), (8, 1, 1), (9, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(5, 40)} - {7, 8}
    calib = {i for i in trusted if zlib.crc32(str(i).encode()) % kneser_ney.CALIBRATION == 0}
    got = kneser_ney.judged(docs, labels, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for lang in ("en", "de", None):
        own = [r for r in rows if r.lang == lang]
        sym = [kneser_ney.symbols_of(r.text).tolist() for r in own]
        train = [s for s, r in zip(sym, own) if r.doc_id in trusted - calib]
        for r, x in zip(own, plain_kn(train, sym)):
            by[r.doc_id].append(None if x is None else round(x, 8))
    thresholds = plain_thresholds(got, calib)
    for r, t in zip(got, thresholds):
        x = None if r.log_ppl is None else round(r.log_ppl, 8)
        assert x in by[r.c0], r
        assert (r.threshold is None) == (t is None) and (t is None or r.threshold == pytest.approx(t, abs=1e-9))
        assert r.kept == (t is not None and r.log_ppl <= t + kneser_ney.ROUNDING)
    assert kneser_ney.keep_likely(docs, labels).columns == docs.columns
    assert kneser_ney.judged(none, labels, ["doc_id"]).count() == 0
    assert kneser_ney.judged(docs, labels.limit(0), ["doc_id"]).where("kept").count() == sum(len(kneser_ney.symbols_of(r.text)) > 0 for r in rows)


def test_encoders_agree_with_the_library_on_any_script():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(11)
    blocks = [(0x20, 0x7E), (0, 0x20), (0x7F, 0x24F), (0x250, 0x5FF), (0x600, 0x1FFF), (0x2000, 0x2FFF), (0x3000, 0x9FFF), (0xA000, 0xD7FF), (0x10000, 0x1FFFF)]
    texts = ["".join(chr(rng.randint(*rng.choice([p, q, blocks[0]]))) for _ in range(rng.randint(0, 30))) for p, q in ((rng.choice(blocks), rng.choice(blocks)) for _ in range(800))]
    texts += ["f(x)=y[1]+a_b-c@d /e/ \"q\" a#b a&b<|endoftext|>c,d x\u2260y =\u0338 \u00e9,\u00e9", "<|STARTOFTEXT|> it's, we'll. \u0130,"]
    path = bpe_trie.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    trie = bpe_trie.trie(path)
    assert [list(memoryview(x).cast("I")) if x else [] for x in trie.encode(texts)] == want
    assert [trie.decode(np.array(x, "<u4").tobytes()) for x in want] == [lib.decode(x, skip_special_tokens=False) for x in want]
    enc = token_store.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, ends = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [e.ids for e in enc.t.encode_batch(texts, add_special_tokens=False)]


def labelled_prose(n, odd, lang="en", first=0):
    """n documents of common words, all labelled good, and `odd` that are labelled bad, each with a tenth of its words in other letters."""
    rng = random.Random(11)
    vocab = [words(rng, 1, "abcdefgh") for _ in range(60)]
    rare = [words(rng, 1, "uvwxyz") for _ in range(60)]
    plain = [[rng.choice(vocab) for _ in range(150)] for _ in range(n + odd)]
    for text in plain[n:]:
        text[::10] = [rng.choice(rare) for _ in text[::10]]
    docs = [(first + i, " ".join(x), lang) for i, x in enumerate(plain)]
    return docs, [(d[0], int(i < n), 0) for i, d in enumerate(docs)]


LABELS = "doc_id long, quality int, toxic int"


def test_kneser_ney_threshold_follows_the_quantile(spark):
    docs, marks = labelled_prose(150, 20)
    got = kneser_ney.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(marks, LABELS), ["doc_id"]).collect()
    bad = {m[0] for m in marks if m[1] == 0}
    assert sum(not r.kept for r in got if r.c0 in bad) >= 19
    marks = {m[0] for m in marks if m[1] == 1 and zlib.crc32(str(m[0]).encode()) % kneser_ney.CALIBRATION == 0}
    want = plain_thresholds(got, marks)
    assert [r.threshold for r in got] == pytest.approx(want) and [r.kept for r in got] == [r.log_ppl <= t + kneser_ney.ROUNDING for r, t in zip(got, want)]
    assert sum(not r.kept for r in got if r.c0 not in bad) <= 6


def test_kneser_ney_rare_language(spark, monkeypatch):
    docs, marks = labelled_prose(150, 0)
    more, theirs = labelled_prose(14, 4, "xx", 1000)
    df, labels = spark.createDataFrame(docs + more, "doc_id long, text string, lang string"), spark.createDataFrame(marks + theirs, LABELS)
    got = {r.c0: r for r in kneser_ney.judged(df, labels, ["doc_id"]).collect()}
    assert all(r.threshold is not None for r in got.values())
    assert not any(got[i].kept for i in range(1014, 1018)) and sum(got[i].kept for i in range(1000, 1014)) >= 11
    monkeypatch.setattr(kneser_ney, "TRAINING", 40)
    ids = kneser_ney.training_ids(kneser_ney.trusted_ids(labels), df, {"en": 1, "xx": 2})
    assert {i for i in ids if i >= 1000} == {i for i in range(1000, 1014) if zlib.crc32(str(i).encode()) % kneser_ney.CALIBRATION} and 10 < len(ids) < 60


NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 2.1 of the License, or
(at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.""",
}


def test_license_keys_are_what_the_normaliser_leaves(spark):
    """Each known sentence normalises to itself, so that none is dead."""
    rows = spark.createDataFrame([(i, s) for i, s in licenses.SENTENCES.items()], "id string, s string")
    odd = rows.where(licenses.normalised(F.col("s"), False) != F.col("s")).collect()
    assert [r.id for r in odd] == ["mpl.subject"]  # the form that splits is `mpl.subject-v`
    assert {i for _, _, ids in licenses.RULES for i in ids} == set(licenses.SENTENCES)


def test_licenses_of_other_texts(spark):
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
    cases = [(bsd.format(x), "BSD-3-Clause") for x in ("copyright holder", "copyright holders", "author", "university", "organization")]
    cases += [(f"// SPDX-License-Identifier: {x}\nint x;", x) for x in licenses.LISTED]
    cases += [("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nx", "EPL-2.0")]
    cases += [("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0")]
    cases += [("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib")]
    got = licenses.scan(spark.createDataFrame([(i, t, 1, 2) for i, (t, _) in enumerate(cases)], "doc_id long, text string, rules int, Licenses int"))
    assert got.columns == ["doc_id", "rules_", "Licenses_", "sentence_ids", "rules", "licenses"]
    assert {r[0]: r.licenses for r in got.select("doc_id", "licenses").collect()} == {i: x for i, (_, x) in enumerate(cases)}


def test_licenses_in_expressions_and_continued_sentences(spark):
    cases = [
        ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;", "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: (GPL-2.0-or-later AND MIT)", "GPL-2.0-or-later,MIT"),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 OR BSD-3-Clause */", "Apache-2.0,BSD-3-Clause,MIT"),
        ("SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1", "GPL-3.0-or-later"),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details", "MIT"),
        ("The software is released under the terms of the MIT license, see LICENSE.txt.", "MIT"),
        ("This library is licensed under the Apache License, Version 2.0 (see LICENSE for details).", "Apache-2.0"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.", "Apache-2.0"),
        ("We think that this project is under no licence; see the file.", ""),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: licence for i, (_, licence) in enumerate(cases)}
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(cases)), "text": [t for t, _ in cases]}))
    assert {r[0]: r[3] for r in con.execute(licenses.OP2_SQL).fetchall()} == {i: licence for i, (_, licence) in enumerate(cases)}


def test_licenses_find_published_notices(spark):
    forms = (lambda t: t, lambda t: " ".join(t.split()), lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")))
    cases = [(f(t), licence) for licence, t in NOTICES.items() for f in forms]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: licence for i, (_, licence) in enumerate(cases)}
    assert all("published" in r.rules for r in got)
