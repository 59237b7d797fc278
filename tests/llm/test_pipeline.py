"""The pipeline on the small tables: stages' decisions and columns, held against plain versions."""

import corpus_pipeline
from tidemark.llm import decontaminate, kneser_ney, quality_rules, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["quality_rules", "quality_classifier", "simhash_near_dedup", "decontamination", "bpe_encoding"]
    good = named["quality_rules"](spark, docs, DATA)
    mask = quality_rules.mask(quality_rules.POLICY)
    want = set()
    for r in docs.collect():
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(r.text.encode())))
        failed = sum(1 << i for i, rule in enumerate(quality_rules.RULES.values()) if eval(rule, {}, m))
        if not failed & mask:
            want.add(r.doc_id)
    assert {r.doc_id for r in good.select("doc_id").collect()} == want and good.columns == columns
    likely = named["quality_classifier"](spark, good, DATA)
    assert likely.columns == columns
    # By the labels: clean documents stay, and of those that a label calls bad or toxic a third goes at least.
    marks = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {r.doc_id for r in likely.collect()}
    clean, odd = ({i for i in want if i in marks and (marks[i] == (1, 0)) == ok} for ok in (True, False))
    assert len(clean - ids) <= 0.02 * len(clean) and len(odd - ids) >= len(odd) / 3
    assert ids == {r.c0 for r in kneser_ney.judged(good, spark.read.parquet(f"{DATA}/labels.parquet"), ["doc_id"]).where("kept").collect()}
    one = named["simhash_near_dedup"](spark, likely, DATA)
    rows = likely.collect()
    marks = [simhash.sketch(r.text.encode()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i][0] ^ marks[j][0]).bit_count() <= simhash.WORD_BITS and sum((a ^ b).bit_count() for a, b in zip(marks[i][1:], marks[j][1:])) <= simhash.SHINGLE_BITS:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(r.doc_id for r, h in zip(rows, group) if h == g) for g in set(group)}
    assert {r.doc_id for r in one.collect()} == set(least.values()) and one.columns == columns
    clean = named["decontamination"](spark, one, DATA)
    ix = decontaminate.index([tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()])
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not decontaminate.matches(r.text, ix)}
    last = named["bpe_encoding"](spark, clean, DATA)
    assert last.count() == clean.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(r.doc_id for r in last.select("doc_id").collect())


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, names that clash, and no rows at all."""
    text = " ".join(f"word{i % 37} other{i % 11} more{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid int, c0 string, items int, fp string, `__failed` int, lang_ int"
    rows = [(i, t, "en", "s", 1, 2, "c", 3, "f", 4, 5) for i, t in enumerate([None, "", text, text, text + " end", text.upper()])]
    rows += [rows[2], (None, text, *[None] * 9), (None, None, *[None] * 9), (9, " ".join(f"x{i} y{i}" for i in range(300)), None, *[None] * 8)]
    spark.createDataFrame([(2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x7 y7 x8 y8 x9 y9 x10 y10"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    left = {"quality_rules": 7, "quality_classifier": 7, "simhash_near_dedup": 3, "decontamination": 9}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == left[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, str(tmp_path)).count() == len(rows) and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
