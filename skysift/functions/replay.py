"""One correlation, one group, in arrival order: the sequential definition that window plans must equal.

Used for what windows can't express (reset on fire), for streaming state, and as the oracle of the tests.
"""

from __future__ import annotations

import math
import operator
from dataclasses import asdict, dataclass, field
from typing import Any

from skysift.plans import conditions

OPS = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge, "eq": operator.eq, "neq": operator.ne}


@dataclass
class State:
    """Open window: entries (ts, ref, value, distinct key), its start and last timestamps, the last alert."""

    entries: list[list[Any]] = field(default_factory=list)
    start: int | None = None
    last: int | None = None
    fired: int | None = None

    def dump(self) -> dict:
        return asdict(self)


def between(low: Any, high: Any, part: Any) -> tuple[Any, Any]:
    """low * (1 - part) + high * part, and what rounding the first product and the sum took from it (NaN for huge values).

    Numbers or columns. Together they are what a fused multiply-add gives; 29.99 and 30.01 have 30.0 between them, where
    low + (high - low) * part may give the double after it.
    """
    weight = 1.0 - part
    product, second = low * weight, high * part
    plain = product + second
    halves = []
    for x in (low, weight):
        big = x * 134217729.0
        top = big - (big - x)
        halves.append((top, x - top))
    (a, b), (c, d) = halves
    of_product = ((a * c - product) + a * d + b * c) + b * d
    back = plain - product
    of_sum = (product - (plain - back)) + (second - back)
    return plain, of_sum + of_product


def percentile(values: list[float], p: float) -> float | None:
    """Linear interpolation at rank p / 100 * (n - 1)."""
    v = sorted(x for x in values if math.isfinite(x))
    if not v:
        return None
    rank = p / 100 * (len(v) - 1)
    low = math.floor(rank)
    high = min(low + 1, len(v) - 1)
    plain, rest = between(v[low], v[high], rank - low)
    return plain if math.isnan(rest) else plain + rest


def ordered(entries: list[list[Any]], refs: list[str]) -> bool:
    """Whether the refs occur in their order at non-decreasing times."""
    stage = 0
    order = {r: i for i, r in enumerate(refs)}
    for ts, ref, *_ in sorted(entries, key=lambda e: (e[0], order.get(e[1], 0))):
        if stage < len(refs) and ref == refs[stage]:
            stage += 1
    return stage == len(refs)


def value(kind: str, entries: list[list[Any]], refs: list[str], rank: float, expression: str | None) -> float | None:
    numbers = [e[2] for e in entries if e[2] is not None]
    if kind == "event_count":
        return float(len(entries))
    if kind == "value_count":
        return float(len({e[3] for e in entries if e[3] is not None}))
    if kind == "value_sum":
        return float(sum(numbers))
    if kind == "value_avg":
        return sum(numbers) / len(numbers) if numbers else 0.0
    if kind == "value_percentile":
        return percentile(numbers, rank)
    if kind == "value_median":
        return percentile(numbers, 50.0)
    seen = {e[1] for e in entries}
    if kind == "temporal_ordered":
        return float(len(refs)) if ordered(entries, refs) else 0.0
    if expression:
        ok = conditions.fold(conditions.parse(expression), refs, lambda n: n in seen, lambda x: not x, all, any, lambda xs, n: sum(xs) >= n)
        return float(len(seen)) if ok else None
    return float(len(seen))


def step(c, s: State, ts: int, ref: str, number: float | None, distinct: str | None) -> float | None:
    """Feed one hit of correlation c; the aggregate if it fires, else None."""
    if c.window == "tumbling":
        bucket = ts - ts % c.timespan
        if s.start is not None and bucket < s.start:
            return None
        if s.start != bucket:
            s.entries, s.start = [], bucket
    elif c.window == "session":
        if s.last is not None and (ts - s.last > c.gap or ts - s.start > c.timespan):
            s.entries, s.start = [], None
        s.start = ts if s.start is None else s.start
        s.last = ts if s.last is None or s.start == ts else max(s.last, ts)
    else:
        s.entries = [e for e in s.entries if e[0] >= ts - c.timespan]
    s.entries.append([ts, ref, number, distinct])
    got = value(c.type, s.entries, c.rules, c.percentile, c.expression)
    if got is None or not all(OPS[k](got, v) for k, v in c.predicates):
        return None
    if c.suppress is not None and s.fired is not None and ts < s.fired + c.suppress:
        return None
    s.fired = ts
    if c.action == "reset":
        s.entries, s.start, s.last = [], None, None
    return got
