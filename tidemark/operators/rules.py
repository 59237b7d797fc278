"""Rule layers of their own evidence: technical gate, market regime and the direction that a total score predicts."""

from __future__ import annotations

from tidemark.functions.frames import BY, full, lag, over, sma, sure, trailing
from tidemark.operators.layers import Layer

#: The four conditions of the technical gate, what each needs, and when it holds. Reads close, ema10, ema20.
GATE = {
    "close_above_sma50": ("gate_sma50 IS NOT NULL", "close > gate_sma50"),
    "ema10_above_ema20": ("gate_pos >= 20", "ema10 > ema20"),
    "moving_average_slopes_positive": ("gate_pos >= 25", "ema10 > ema10_back AND ema20 > ema20_back"),
    "within_20pct_of_52_week_high": ("high_close_252 IS NOT NULL", "close / high_close_252 - 1 >= -0.20D"),
}


def _state(name: str) -> str:
    known, holds = GATE[name]
    return f"CASE WHEN NOT ({known}) THEN 'missing' WHEN {holds} THEN 'pass' ELSE 'fail' END"


#: technical_gate is fail if any condition fails, else missing if any lacks its history, else pass.
TECHNICAL_GATE: list[Layer] = [
    {
        "gate_pos": f"row_number() OVER ({BY})",
        "gate_sma50": sma("close", 50),
        "ema10_back": lag("ema10", 5),
        "ema20_back": lag("ema20", 5),
        "high_close_252": full("max", "close", 252, trailing(252)),
    },
    {f"gate_{n}": _state(n) for n in GATE},
    {
        "technical_gate": "CASE WHEN 'fail' IN (" + ", ".join(f"gate_{n}" for n in GATE) + ") THEN 'fail' WHEN 'missing' IN (" + ", ".join(f"gate_{n}" for n in GATE) + ") THEN 'missing' ELSE 'pass' END",
        "passed_conditions": " + ".join(f"CASE WHEN gate_{n} = 'pass' THEN 1 ELSE 0 END" for n in GATE),
        "preferred_within_15pct": sure("close / high_close_252 - 1 >= -0.15D"),
    },
]

#: The market's state from two indices, one row a session: open to volume and ema20 of the lead, s_close of the second.
REGIME: list[Layer] = [
    {
        "r_back": lag("close"),
        "r_volume": full("avg", "volume", 20, over("20 PRECEDING", "1 PRECEDING")),
        "r_5": f"close / nullif({lag('close', 5)}, 0) - 1",
        "r_20": f"close / nullif({lag('close', 20)}, 0) - 1",
        "r_top": full("max", "close", 63, over("63 PRECEDING", "1 PRECEDING")),
        "r_50": sma("close", 50),
        "r_200": sma("close", 200),
        "r_s50": sma("s_close", 50),
    },
    {"r_range": "greatest(high - low, coalesce(abs(high - r_back), 0), coalesce(abs(low - r_back), 0))", "r_day": "CASE WHEN r_volume IS NOT NULL THEN CASE WHEN close < r_back AND volume > r_volume THEN 1 ELSE 0 END END"},
    {"r_atr": f"({sma('r_range', 20)}) / close", "r_days": full("sum", "r_day", 20, trailing(20))},
    {
        "r_known": "r_5 IS NOT NULL AND r_20 IS NOT NULL AND r_top IS NOT NULL AND r_atr IS NOT NULL AND r_days IS NOT NULL AND r_200 IS NOT NULL AND r_s50 IS NOT NULL",
        "pressure_conditions": "CASE WHEN close < ema20 THEN 1 ELSE 0 END + CASE WHEN s_close < r_s50 THEN 1 ELSE 0 END + CASE WHEN r_20 < 0 THEN 1 ELSE 0 END + CASE WHEN r_days >= 4 THEN 1 ELSE 0 END",
    },
    {
        "regime": "CASE WHEN NOT r_known THEN 'unavailable' WHEN r_5 <= -0.07 OR (r_20 <= -0.12 AND r_atr >= 0.025) THEN 'acute_selloff' WHEN close < r_50 AND (r_20 <= -0.05 OR close / r_top - 1 <= -0.08) THEN 'correction' "
        "WHEN pressure_conditions >= 2 THEN 'under_pressure' WHEN close > ema20 AND close > r_50 AND close > r_200 THEN 'uptrend' ELSE 'range_bound' END"
    },
]

# Least total, direction, probability and multiple of the daily range, from the best down.
DIRECTIONS = ((90, "up", 0.74), (80, "up", 0.66), (70, "weak_up", 0.585), (55, "sideways", 0.50), (45, "weak_down", 0.42), (None, "down", 0.35))
MOVES = {"up": 3.0, "weak_up": 1.5, "sideways": 0.0, "weak_down": -1.5, "down": -3.0}


def _pick(at: int) -> str:
    cases = " ".join(f"WHEN total >= {least} THEN {value!r}{'D' if at == 2 else ''}" for least, *rest in DIRECTIONS[:-1] for value in [rest[at - 1]])
    last = DIRECTIONS[-1][at]
    return f"CASE {cases} ELSE {last!r}{'D' if at == 2 else ''} END"


#: Direction, probability, move and confidence of a total, with three vetoes that press it down. Reads total, market_ok,
#: over_pivot (percent, null for none), volume_ratio, breakout, adr_20, rs and gaps (whether data lack).
PREDICTION: list[Layer] = [
    {"veto_market": "NOT coalesce(market_ok, false)", "veto_chase": sure("over_pivot > 5"), "veto_volume": sure("volume_ratio > 0 AND volume_ratio < 1 AND breakout"), "base_direction": _pick(1), "base_probability": _pick(2)},
    {
        "direction": "CASE WHEN base_direction = 'up' AND (veto_market OR veto_volume) THEN 'weak_up' ELSE base_direction END",
        "up_probability": "least(base_probability, CASE WHEN veto_market THEN 0.55D ELSE 1D END, CASE WHEN veto_chase THEN 0.5D ELSE 1D END)",
        "vetoes": "concat_ws(',', CASE WHEN veto_market THEN 'market_not_confirmed' END, CASE WHEN veto_chase THEN 'beyond_pivot' END, CASE WHEN veto_volume THEN 'breakout_on_low_volume' END)",
    },
    {
        "expected_move": "round(coalesce(nullif(adr_20, 0), 3D) * CASE direction " + " ".join(f"WHEN '{d}' THEN {m}D" for d, m in MOVES.items()) + " END, 1)",
        "confidence": "CASE WHEN vetoes <> '' OR rs IS NULL THEN CASE WHEN gaps THEN 'low' ELSE 'medium' END WHEN gaps THEN 'medium' ELSE 'high' END",
    },
]
