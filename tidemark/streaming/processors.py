"""Stateful processors of event streams: effective trades with retractions, and the liveness of symbols by timers.

They need the state store `ROCKSDB` in spark.sql.streaming.stateStore.providerClass. State is held by symbol, in maps of which
a call reads only what it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CHANGES = "symbol string, event_id long, version long, op string, ns long, price double, size double, replaced_by long"


#: Parts that symbols are dealt to; a stream's state keeps its number.
PARTS = 256
#: Neighbouring ids that share an entry of the state.
PAGE = 64
ENTRIES = "ids array<long>, ns array<long>, price array<double>, size array<double>, shown array<string>, linked array<boolean>, new_id array<long>, new_price array<double>, back array<array<long>>"


@dataclass
class _Entry:
    """What is known of an id, in the order of ENTRIES. shown: what the log says of it, null if it is no trade's."""

    ns: int | None = None
    price: float | None = None
    size: float | None = None
    shown: str | None = None
    linked: bool = False
    new_id: int | None = None
    new_price: float | None = None
    back: list[int] | None = None


def _integer(x) -> int | None:
    return None if x is None or x != x else int(x)


class EffectiveTrades(StatefulProcessor):
    """Trades, corrections and cancels of symbols, in any order, to a log of what their trades are now.

    The key is a part of the symbols, so that a call is not for a handful of rows; ids count inside their symbol. Input columns: symbol, kind (trade, correction, cancel), event_id of a trade, old_id and new_id of a change, ns, price, size. Links lead from
    an id to its replacement; `back` leads from an id to those it replaces, so a change touches only the trades whose
    chain it is in. A change that comes before its trade waits in the links. Of several changes of one id the
    greatest new_id counts, and a cancel only where nothing replaces the id. State is held by pages of PAGE neighbouring ids of a symbol:
    for each batch of rows a page that is needed is read once and one that was changed is written once, however many of its ids are
    met. Versions count along a part. ttl_ms: after so long without an update a page is forgotten; None keeps all.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = {"ttlDurationMs": self.ttl} if self.ttl else {}
        self.pages = handle.getMapState("pages", "symbol string, page long", ENTRIES, **kept)
        self.version = handle.getValueState("version", "n long")

    def _page(self, symbol: str | None, at: int) -> dict[int, _Entry]:
        page = symbol, at // PAGE
        if page not in self.held:
            found = self.pages.getValue(page)
            self.held[page] = {} if found is None else {i: _Entry(*values) for i, *values in zip(*found)}
        return self.held[page]

    def _entry(self, symbol: str | None, at: int) -> _Entry | None:
        return self._page(symbol, at).get(at)

    def _own(self, symbol: str | None, at: int) -> _Entry:
        """The entry of an id that is about to change."""
        self.changed.add((symbol, at // PAGE))
        return self._page(symbol, at).setdefault(at, _Entry())

    def _end(self, symbol: str | None, root: int) -> tuple[bool, float | None, int | None]:
        """Whether the trade stands, and the price and id of the last correction."""
        at, price, last, met = root, None, None, set()
        while (entry := self._entry(symbol, at)) is not None and entry.linked:
            if entry.new_id is None or entry.new_id in met or entry.new_id == at:
                return False, None, None
            met.add(at)
            at, price, last = entry.new_id, entry.new_price, entry.new_id
        return True, price, last

    def _roots(self, symbol: str | None, start: int) -> list[int]:
        """Trades from which a chain leads to start."""
        met, todo, roots = {start}, [start], []
        while todo:
            at = todo.pop()
            if (entry := self._entry(symbol, at)) is None:
                continue
            if entry.shown is not None:
                roots.append(at)
            for old in entry.back or []:
                if old not in met:
                    met.add(old)
                    todo.append(old)
        return roots

    def _shown(self, symbol: str | None, root: int) -> tuple | None:
        """The log's row for a trade, if it says something new."""
        entry = self._entry(symbol, root)
        stands, new_price, last = self._end(symbol, root)
        op, price_now = ("upsert", new_price if new_price is not None else entry.price) if stands else ("delete", None)
        mark = f"{op}|{price_now!r}|{last}"
        if mark == entry.shown or op == "delete" and not entry.shown:
            return None
        self._own(symbol, root).shown = mark
        return op, entry.ns, price_now, entry.size if stands else None, last

    def _link(self, symbol: str | None, old: int, new: int | None, price: float | None) -> bool:
        """Whether the change counts, and so is held."""
        entry = self._entry(symbol, old)
        if entry is not None and entry.linked:
            had = entry.new_id
            if (new if new is not None else -1) <= (had if had is not None else -1):
                return False
            if had is not None:
                self._own(symbol, had).back = [x for x in self._entry(symbol, had).back or [] if x != old]
        entry = self._own(symbol, old)
        entry.linked, entry.new_id, entry.new_price = True, new, price
        if new is not None:
            after = self._own(symbol, new)
            after.back = [*(after.back or []), old]
        return True

    def _taken(self, rows: pd.DataFrame) -> list[tuple]:
        """Takes rows in; the log's rows for the trades they touch, without versions."""
        touched: dict[tuple[str | None, int], None] = {}
        for symbol, kind, event_id, old_id, new_id, ns, price, size in zip(*(rows[c].tolist() for c in ("symbol", "kind", "event_id", "old_id", "new_id", "ns", "price", "size"))):
            if kind == "trade":
                if (at := _integer(event_id)) is not None and ((entry := self._entry(symbol, at)) is None or entry.shown is None):
                    entry = self._own(symbol, at)
                    entry.ns, entry.price, entry.size, entry.shown = _integer(ns), float(price), float(size), ""
                    touched[symbol, at] = None
            elif kind in ("correction", "cancel") and (old := _integer(old_id)) is not None:
                if self._link(symbol, old, _integer(new_id) if kind == "correction" else None, None if price is None or price != price else float(price)):
                    touched |= dict.fromkeys((symbol, root) for root in self._roots(symbol, old))
        return [(*at, *shown) for at in touched if (shown := self._shown(*at)) is not None]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.version.get()
        n = found[0] if found is not None else 0
        for pdf in rows:
            self.held: dict[tuple[str | None, int], dict[int, _Entry]] = {}
            self.changed: set[tuple[str | None, int]] = set()
            out = self._taken(pdf)
            for page in self.changed:
                self.pages.updateValue(page, tuple(map(list, zip(*((at, *vars(e).values()) for at, e in self.held[page].items())))))
            if out:
                symbol, root, op, ns, price, size, last = zip(*out)
                made = {"symbol": symbol, "event_id": root, "version": range(n + 1, n + len(out) + 1), "op": op, "ns": pd.array(ns, "Int64"), "price": pd.array(price, "float64"), "size": pd.array(size, "float64"), "replaced_by": pd.array(last, "Int64")}
                n += len(out)
                yield pd.DataFrame(made)
        self.version.update((n,))

    def close(self) -> None:
        pass


def effective_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The log of EffectiveTrades on a stream whose symbol is a string; write it in update mode."""
    return events.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(PARTS))).groupBy("part").transformWithStateInPandas(EffectiveTrades(ttl_ms), CHANGES, "Update", "None")


def effective_now(log: DataFrame) -> DataFrame:
    """The trades that a log of effective_stream leaves: of each trade the newest row, unless it is a deletion. A row that is there twice counts once."""
    last = log.groupBy("symbol", "event_id").agg(F.max_by(F.struct("op", "ns", "price", "size", "replaced_by"), "version").alias("r"))
    return last.where("r.op = 'upsert'").select("symbol", "event_id", "r.ns", "r.price", "r.size", "r.replaced_by")


class Liveness(StatefulProcessor):
    """A symbol is pending from its subscription on, live from its first event on, stale after a silence, then disconnected.

    Input columns: kind (`subscribe` or an event's) and event_ts. Each event sets the timer anew; when it fires the state falls by one step.
    With event time the watermark of all symbols drives the timers, so a replay gives the same states; with processing time the clock does.
    """

    def __init__(self, stale_ms: int, gone_ms: int, by_event_time: bool):
        self.steps, self.by_event_time = {"stale": stale_ms, "disconnected": gone_ms}, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "name string, seen_ms long")

    def _set(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def _row(self, key, name: str, at_ms: int) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [key[0]], "state": [name], "at_ms": [at_ms]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was, seen = self.state.get() if self.state.exists() else (None, -1)
        name = was
        for pdf in rows:
            stamps = pd.to_datetime(pdf["event_ts"], utc=True).astype("datetime64[ms, UTC]").astype("int64")
            heard = pdf["kind"] != "subscribe"
            if heard.any():
                newest = int(stamps[heard].max())
                seen, name = max(seen, newest), "live" if newest >= seen or name != "live" and newest + self.steps["stale"] > seen else name
            elif name is None:
                seen, name = max(seen, int(stamps.max())), "pending"
        now = seen if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
        self.state.update((name, seen))
        if name in ("live", "pending"):
            self._set(now + self.steps["stale"])
        if name != was:
            yield self._row(key, name, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name, seen = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentWatermarkInMs() if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
        rows = []
        while name != "disconnected" and at <= now:  # a long silence may pass both steps at once
            name = "disconnected" if name == "stale" else "stale"
            rows.append(self._row(key, name, at))
            at += self.steps["disconnected"]
        self.state.update((name, seen))
        if name == "stale":
            self._set(at)
        if rows:
            yield pd.concat(rows)

    def close(self) -> None:
        pass


def liveness_stream(events: DataFrame, stale_ms: int, gone_ms: int, watermark: str | None = None) -> DataFrame:
    """symbol, state and at_ms whenever a symbol's state changes. gone_ms: from stale to disconnected. With a watermark timers go by event time, without one by the clock."""
    rows = events.withWatermark("event_ts", watermark) if watermark else events
    return rows.groupBy("symbol").transformWithStateInPandas(Liveness(stale_ms, gone_ms, bool(watermark)), "symbol string, state string, at_ms long", "Update", "EventTime" if watermark else "ProcessingTime")
