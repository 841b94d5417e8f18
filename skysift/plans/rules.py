"""Detection, correlation and filter rules: YAML -> dataclasses. Driver-side only."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from skysift.plans import conditions

#: The safe loader, in C where it is there.
LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2629746, "y": 31556952}
TYPES = ("event_count", "value_count", "value_sum", "value_avg", "value_percentile", "value_median", "temporal", "temporal_ordered")
PREDICATES = ("lt", "lte", "gt", "gte", "eq", "neq")
QUANTIFIERS = ("any", "all", "all_or_empty", "none")


class BadRule(ValueError):
    """A rule that can't be compiled."""


def seconds(text: str | int) -> int:
    """`10m` -> 600. Units s m h d w M (30.44 days) y (365.24 days)."""
    m = re.fullmatch(r"(\d+)([smhdwMy])", str(text).strip())
    if not m:
        raise BadRule(f"bad time span {text!r}")
    return int(m[1]) * UNITS[m[2]]


@dataclass
class Item:
    """One `field|modifiers: values` line. field None: keywords. block: a nested array body."""

    field: str | None
    modifiers: list[str]
    values: list[Any]
    quantifier: str | None = None
    block: Detection | None = None


@dataclass
class Detection:
    """items AND-ed; any_of OR-ed; named sub-detections with a condition."""

    items: list[Item] = field(default_factory=list)
    any_of: list[Detection] = field(default_factory=list)
    named: dict[str, Detection] = field(default_factory=dict)
    condition: str | None = None


@dataclass
class Rule:
    title: str
    id: str | None = None
    name: str | None = None
    level: str | None = None
    status: str | None = None
    tags: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    logsource: dict[str, str] = field(default_factory=dict)
    detections: dict[str, Detection] = field(default_factory=dict)
    conditions: list[str] = field(default_factory=list)
    attributes: dict[str, Any] = field(default_factory=dict)
    raw: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return self.id or self.name or self.title


@dataclass
class Correlation:
    title: str
    id: str | None
    name: str | None
    type: str
    rules: list[str]
    group_by: list[str]
    timespan: int
    predicates: list[tuple[str, float]]
    value_fields: list[str] = field(default_factory=list)
    percentile: float = 50.0
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    window: str = "sliding"
    gap: int | None = None
    expression: str | None = None
    generate: bool = False
    level: str | None = None
    tags: list[str] = field(default_factory=list)
    suppress: int | None = None
    action: str = "alert"

    @property
    def key(self) -> str:
        return self.id or self.name or self.title


@dataclass
class Filter:
    title: str
    rules: list[str] | None
    logsource: dict[str, str]
    detections: dict[str, Detection]
    condition: str


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    correlations: list[Correlation] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)


def _values(v: Any) -> list[Any]:
    return list(v) if isinstance(v, list) else [v]


def _item(key: str, value: Any) -> Item:
    name, *mods = key.split("|")
    m = re.fullmatch(r"(.*)\[(any|all|all_or_empty|none)\]", name, re.S)
    name, quantifier = (m[1], m[2]) if m else (name, None)
    if isinstance(value, (dict, list)) and quantifier and (isinstance(value, dict) or value and all(isinstance(x, dict) for x in value)):
        return Item(name, mods, [], quantifier, detection(value))
    if isinstance(value, dict):
        raise BadRule(f"{key}: a nested map needs an array quantifier")
    return Item(name or None, mods, _values(value), quantifier)


def detection(body: Any) -> Detection:
    """A map is AND, a list of maps OR, a list of scalars keywords; a map with `condition` names its parts."""
    if isinstance(body, dict):
        if "condition" in body and all(isinstance(v, (dict, list)) for k, v in body.items() if k != "condition"):
            return Detection(named={k: detection(v) for k, v in body.items() if k != "condition"}, condition=str(body["condition"]))
        return Detection(items=[_item(str(k), v) for k, v in body.items()])
    if isinstance(body, list):
        maps = [x for x in body if isinstance(x, (dict, list))]
        words = [x for x in body if not isinstance(x, (dict, list))]
        if not maps:
            return Detection(items=[Item(None, [], words)])
        return Detection(any_of=[detection(x) for x in maps] + ([Detection(items=[Item(None, [], words)])] if words else []))
    return Detection(items=[Item(None, [], [body])])


def _detections(doc: dict) -> tuple[dict[str, Detection], list[str]]:
    body = dict(doc.get("detection") or {})
    body.pop("timeframe", None)
    condition = body.pop("condition", None)
    if not body or condition is None:
        raise BadRule(f"{doc.get('title')!r}: a rule needs detections and a condition")
    return {k: detection(v) for k, v in body.items()}, [str(c) for c in _values(condition)]


def _correlation(doc: dict) -> Correlation:
    c = doc["correlation"]
    kind = str(c.get("type"))
    if kind not in TYPES:
        raise BadRule(f"unknown correlation type {kind!r}")
    refs = [str(r) for r in _values(c.get("rules") or [])]
    cond, expression, names, percentile = c.get("condition"), None, [], 50.0
    predicates: list[tuple[str, float]] = []
    if isinstance(cond, dict):
        predicates = [(k, float(v)) for k, v in cond.items() if k in PREDICATES]
        names = [str(x) for x in _values(cond.get("field") or [])]
        percentile = float(cond.get("percentile", 50.0))
    elif isinstance(cond, str):
        expression = cond
        if not refs:
            refs = sorted(conditions.names_in(conditions.parse(cond)))
    if not refs:
        raise BadRule(f"{doc.get('title')!r}: a correlation needs rules")
    if kind.startswith("value") and not names:
        raise BadRule(f"{doc.get('title')!r}: {kind} needs a field")
    if not predicates and expression is None:
        if not kind.startswith("temporal"):
            raise BadRule(f"{doc.get('title')!r}: {kind} needs a threshold")
        predicates = [("gte", float(len(refs)) if kind == "temporal_ordered" else 1.0)]
    if "timespan" not in c and "timeframe" not in c:
        raise BadRule(f"{doc.get('title')!r}: a correlation needs a time span")
    attrs = {**{k: v for k, v in doc.items() if str(k).startswith("skysift.")}, **(doc.get("custom_attributes") or {})}
    option = lambda n: next((v for k, v in attrs.items() if str(k).rpartition(".")[2] == n), None)
    window = str(c.get("window", "session" if c.get("gap") else "sliding"))
    if window not in ("sliding", "tumbling", "session"):
        raise BadRule(f"unknown window {window!r}")
    if window == "session" and not c.get("gap"):
        raise BadRule("a session window needs a gap")
    return Correlation(
        str(doc.get("title", "")), doc.get("id") and str(doc["id"]), doc.get("name"), kind, refs, [str(x) for x in _values(c.get("group-by") or [])], seconds(c.get("timespan", c.get("timeframe"))), predicates, names, percentile,
        c.get("aliases") or {}, window, seconds(c["gap"]) if c.get("gap") else None, expression, bool(c.get("generate", False)), doc.get("level"), list(doc.get("tags") or []),
        seconds(option("suppress")) if option("suppress") else None, str(option("action") or "alert"),
    )


def _merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(text: str) -> RuleSet:
    """Rules from one or more YAML documents; `action: global`, `reset` and `repeat` merge documents."""
    out, shared, last = RuleSet(), {}, {}
    for doc in yaml.load_all(text, LOADER):
        if not isinstance(doc, dict):
            continue
        doc = dict(doc)
        action = doc.pop("action", None)
        if action == "global":
            shared = _merge(shared, doc)
            continue
        if action == "reset":
            shared = {}
            continue
        doc = _merge(last, doc) if action == "repeat" else _merge(shared, doc)
        last = doc
        if "correlation" in doc:
            out.correlations.append(_correlation(doc))
        elif "filter" in doc:
            f = dict(doc["filter"])
            refs, condition = f.pop("rules", "any"), f.pop("condition", None)
            if condition is None:
                raise BadRule("a filter needs a condition")
            out.filters.append(Filter(str(doc.get("title", "")), None if refs == "any" else [str(x) for x in _values(refs)], doc.get("logsource") or {}, {k: detection(v) for k, v in f.items()}, str(_values(condition)[0])))
        else:
            found, conds = _detections(doc)
            out.rules.append(Rule(
                str(doc.get("title", "")), doc.get("id") and str(doc["id"]), doc.get("name"), doc.get("level"), doc.get("status"), [str(t) for t in doc.get("tags") or []], [str(x) for x in doc.get("fields") or []],
                {k: str(v) for k, v in (doc.get("logsource") or {}).items()}, found, conds, doc.get("custom_attributes") or {}, doc,
            ))
    return out


def load_path(path: str) -> RuleSet:
    """A rule file, or all .yml and .yaml files below a folder, in name order."""
    p = Path(path)
    files = sorted(x for x in p.rglob("*") if x.suffix in (".yml", ".yaml")) if p.is_dir() else [p]
    out = RuleSet()
    for f in files:
        got = load(f.read_text(encoding="utf-8"))
        out.rules += got.rules
        out.correlations += got.correlations
        out.filters += got.filters
    return out


def _contains(rule_source: dict[str, str], wanted: dict[str, str]) -> bool:
    return all(str(rule_source.get(k, "")).lower() == str(v).lower() for k, v in wanted.items() if k in ("product", "category", "service"))


def apply_filters(rules: RuleSet) -> RuleSet:
    """Rules with the filters' conditions AND-ed on, under names of their own; filters match rules by id or title."""
    out = RuleSet([copy.deepcopy(r) for r in rules.rules], list(rules.correlations), list(rules.filters))
    for n, f in enumerate(rules.filters):
        for r in out.rules:
            if f.rules is not None and r.id not in f.rules and r.title not in f.rules or not _contains(r.logsource, f.logsource):
                continue
            prefix = f"__filter_{n}_"
            rename = lambda t, p=prefix: ("name", p + t[1]) if t[0] == "name" else ("not", rename(t[1])) if t[0] == "not" else ("of", t[1], p + ("*" if t[2].lower() == "them" else t[2])) if t[0] == "of" else (t[0], [rename(x) for x in t[1]])  # noqa: E731, B023
            r.detections.update({prefix + k: v for k, v in f.detections.items()})
            extra = show(rename(conditions.parse(f.condition)))
            r.conditions = [f"({c}) and ({extra})" for c in r.conditions]
    return out


def show(tree: tuple) -> str:
    """A condition tree as text again."""
    kind = tree[0]
    if kind == "name":
        return tree[1]
    if kind == "not":
        return f"not ({show(tree[1])})"
    if kind == "of":
        return f"{tree[1]} of {tree[2]}"
    return f" {kind} ".join(f"({show(t)})" for t in tree[1])
