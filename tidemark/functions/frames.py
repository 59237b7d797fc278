"""Frames over a ticker's sessions, as SQL text for expressions, and guarded aggregates over them.

Frames are counted in sessions. A guarded aggregate is null until its frame is full, since Spark's frames
start short.
"""

from __future__ import annotations

BY = "PARTITION BY ticker ORDER BY session"


def over(first: str, last: str) -> str:
    return f"OVER ({BY} ROWS BETWEEN {first} AND {last})"


def trailing(n: int) -> str:
    """The last n sessions with the current one."""
    return over(f"{n - 1} PRECEDING", "CURRENT ROW")


def prior(n: int) -> str:
    """The n sessions before the current one."""
    return over(f"{n} PRECEDING", "1 PRECEDING")


def future(n: int) -> str:
    """The n sessions after the current one."""
    return over("1 FOLLOWING", f"{n} FOLLOWING")


PREFIX = over("UNBOUNDED PRECEDING", "CURRENT ROW")
PAST = over("UNBOUNDED PRECEDING", "1 PRECEDING")


def full(agg: str, x: str, n: int, frame: str, least: int | None = None) -> str:
    """The aggregate where at least `least` (n by default) of the frame's values are not null."""
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {agg}({x}) {frame} END"


def sma(x: str, n: int) -> str:
    return full("avg", x, n, trailing(n))


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({BY})"


def change(x: str, n: int = 1) -> str:
    return f"{x} / nullif({lag(x, n)}, 0) - 1"


def sure(condition: str) -> str:
    """A comparison with a missing input is false."""
    return f"coalesce({condition}, false)"


def rank_pct(x: str, by: str) -> str:
    """Percentile rank in which ties get their mean rank; null values have none."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0D) / count({x}) OVER (PARTITION BY {by}) END"


def rule(value: str, weight: float, met: str, near: str | None = None) -> tuple[str, str]:
    """(points, available weight) of one rule: its weight if met, half of it if near, nothing available without a value."""
    close = f"WHEN {value} {near} THEN {weight / 2}D " if near else ""
    return f"CASE WHEN {value} {met} THEN {weight}D {close}ELSE 0D END", f"CASE WHEN {value} IS NOT NULL THEN {weight}D ELSE 0D END"


def coverage_score(rules: list[tuple[str, str]], least: float, total: float) -> str:
    """Points over available weight in percent, where the available share reaches `least`."""
    points, available = " + ".join(p for p, _ in rules), " + ".join(a for _, a in rules)
    return f"CASE WHEN ({available}) / {total}D >= {least}D THEN ({points}) / ({available}) * 100D END"
