"""Cases of the third round's findings."""

import datetime

import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidemark.llm import kneser_ney
from tidemark.plans import stateful
from tidemark.streaming import processors


def test_messages_of_events_without_a_price_are_valid(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    values = [0.0, 3.5, None, -2.0, 1e17]
    rows = [(50 * (i % 2) + 2 * k + 1 - i % 2, at + datetime.timedelta(seconds=10 * k + i), 1, kind, v, '{"k": 2}') for k, v in enumerate(values) for i, kind in enumerate(("view", "purchase"))]
    rows += [(100 * k + 50, at, 1, "view", v, '{"k": 2}') for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(stateful.R01_SQL).fetchall())
    assert sorted((r.kind, r.reason, r.n, r.newest_ns) for r in stateful.r01_normalised_messages(spark, str(tmp_path)).collect()) == want
    assert ("quote", "invalid_quote", 5) in [x[:3] for x in want]


@pytest.mark.parametrize("few", [kneser_ney.BROADCAST_IDS, 0])
def test_all_trusted_documents_are_counted(spark, monkeypatch, few):
    monkeypatch.setattr(kneser_ney, "TRAINING", 5)
    monkeypatch.setattr(kneser_ney, "BROADCAST_IDS", few)
    monkeypatch.setattr(kneser_ney, "BLOCK_CHARS", 100)
    monkeypatch.setattr(kneser_ney, "CHUNK", 30)
    texts = {i: f"word {i} of {i % 7}" if i % 9 else None for i in range(60)}
    docs = spark.createDataFrame([*((i, "en", t) for i, t in texts.items()), (3, "en", "again"), (None, "en", "no id")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([*((i, int(i % 5 > 0), 0) for i in texts), (3, 1, 0)], "doc_id long, quality long, toxic long")
    met, counts = Counter(), []
    monkeypatch.setattr(kneser_ney, "probabilities", lambda asked, known, real=kneser_ney.probabilities: counts.extend(known.collect()) or real(asked, known))
    assert kneser_ney.judged(docs, labels, ["doc_id"]).count() == 62
    for i, t in [*texts.items(), (3, "again")]:
        if i % 5 and zlib.crc32(str(i).encode()) % kneser_ney.CALIBRATION:
            symbols = [0, 0, 0, *kneser_ney.symbols_of(t).tolist()]
            met.update(1 << 48 | sum(symbols[k + 3 - j] << 12 * j for j in range(4)) for k in range(len(symbols) - 3))
    assert {r.g: r.n for r in counts} == met


def test_effective_stream_reads_a_page_of_state_once_for_a_batch(monkeypatch):
    reads, writes, state = Counter(), Counter(), {}

    class Pages:
        def getValue(self, page):
            reads[page] += 1
            return state.get(page)

        def updateValue(self, page, value):
            writes[page] += 1
            state[page] = value

    class Version:
        n = None

        def get(self):
            return self.n

        def update(self, n):
            self.n = n

    p = processors.EffectiveTrades()
    p.pages, p.version = Pages(), Version()
    trades = [(s, "trade", i, None, None, i, float(i), 1.0) for i in range(1, 60) for s in ("a", None)]
    changes = [("a", "correction", None, 1, 2, 0, 7.0, 0.0), (None, "cancel", None, 3, None, 0, None, 0.0)]
    columns = ["symbol", "kind", "event_id", "old_id", "new_id", "ns", "price", "size"]
    frames = [pd.DataFrame(x, columns=columns) for x in (trades, changes)]
    log = [tuple(r) for out in p.handleInputRows((0,), iter(frames), None) for r in out.itertuples(index=False)]
    assert len(log) == 120 and [r[2] for r in log] == list(range(1, 121))
    assert [r[:2] + (r[3], r[5]) for r in log[118:119]] == [("a", 1, "upsert", 7.0)] and log[118][7] == 2
    assert log[119][0] is None and log[119][1] == 3 and log[119][3] == "delete"
    assert set(reads.values()) == set(writes.values()) == {2} and len(reads) == 2
