"""Rules as Spark SQL text: predicates, views, and window queries for correlations.

The engine itself runs rules as Columns; this is for handing a rule to a SQL warehouse. Only what has a plain SQL form is
emitted; array blocks, keywords and sequential correlations raise BadRule.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from skysift.functions.literals import wildcard_parts, wildcard_regex
from skysift.plans import conditions
from skysift.plans.rules import BadRule, Correlation, Detection, Item, Rule, RuleSet

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "<>"}
_AGGREGATES = {"event_count": "count(*)", "value_sum": "coalesce(sum({v}), 0)", "value_avg": "coalesce(avg({v}), 0)", "value_median": "median({v})", "value_percentile": "percentile({v}, {p})"}


def name(path: str) -> str:
    """A dotted path as a SQL name, parts quoted where they need it."""
    return ".".join(p if _PLAIN.match(p) else "`" + p.replace("`", "``") + "`" for p in path.split("."))


def literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _text(column: str, value: str, mods: set[str]) -> str:
    parts = wildcard_parts(value)
    cased = "cased" in mods
    c = f"CAST({column} AS STRING)" if cased else f"lower(CAST({column} AS STRING))"
    if all(isinstance(p, str) for p in parts):
        want = literal("".join(parts) if cased else "".join(parts).lower())
        for m in ("contains", "startswith", "endswith"):
            if m in mods:
                return f"{m}({c}, {want})"
        return f"{c} = {want}"
    pattern = wildcard_regex(parts, not mods & {"contains", "endswith"}, not mods & {"contains", "startswith"}, not cased)
    return f"CAST({column} AS STRING) RLIKE {literal(pattern)}"


def _one(column: str, value: Any, mods: set[str]) -> str:
    if "re" in mods:
        flags = "".join(f for f in "ims" if f in mods)
        return f"CAST({column} AS STRING) RLIKE {literal((f'(?{flags})' if flags else '') + str(value))}"
    for m in ("gt", "gte", "lt", "lte"):
        if m in mods:
            return f"try_cast({column} AS DOUBLE) {_OPS[m]} {float(value)!r}"
    if "exists" in mods:
        return f"{column} IS {'NOT ' if value else ''}NULL"
    if "fieldref" in mods:
        return f"lower(CAST({column} AS STRING)) = lower(CAST({name(str(value))} AS STRING))"
    if mods & {"cidr", "expand", "base64", "base64offset", "windash", "wide", "utf16", "utf16le", "utf16be", "minute", "hour", "day", "week", "month", "year"}:
        raise BadRule(f"no SQL text for modifiers {sorted(mods)}")
    if value is None:
        return f"{column} IS NULL"
    if isinstance(value, bool):
        return f"lower(CAST({column} AS STRING)) IN ({', '.join(map(literal, ('true', '1', 'yes') if value else ('false', '0', 'no')))})"
    if isinstance(value, (int, float)):
        return f"try_cast({column} AS DOUBLE) = {float(value)!r}"
    return _text(column, value, mods)


def item(i: Item) -> str:
    """One `field|modifiers: values` line as a predicate."""
    if i.field is None or i.block or i.quantifier or "[" in i.field:
        raise BadRule("no SQL text for keywords and array blocks")
    mods, column = set(i.modifiers), name(i.field)
    tests = [_one(column, v, mods - {"all", "neq"}) for v in i.values]
    joined = (" AND " if "all" in mods and "neq" not in mods else " OR ").join(f"({t})" if len(tests) > 1 else t for t in tests)
    return f"{column} IS NOT NULL AND NOT coalesce({joined}, false)" if "neq" in mods else joined


def detection(d: Detection) -> str:
    parts = [f"({item(i)})" for i in d.items]
    if d.any_of:
        parts.append("(" + " OR ".join(f"({detection(x)})" for x in d.any_of) + ")")
    if d.named:
        parts.append(f"({condition(d.condition or '', d.named)})")
    return " AND ".join(parts) or "true"


def condition(text: str, named: dict[str, Detection]) -> str:
    """A condition over named detections; unknown counts as false beneath a negation and in counts."""

    def count(chosen: list[str], n: int) -> str:
        return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in chosen or ["false"]) + f") >= {n}"

    return conditions.fold(
        conditions.parse(text), list(named), lambda n: f"({detection(named[n])})", lambda t: f"NOT coalesce({t}, false)", lambda ts: "(" + " AND ".join(ts) + ")", lambda ts: "(" + " OR ".join(ts) + ")", count
    )


def predicate(rule: Rule) -> str:
    """The WHERE clause of a rule; several conditions are alternatives."""
    return " OR ".join(condition(c, rule.detections) for c in rule.conditions)


def query(rule: Rule, table: str, template: str = "SELECT {fields} FROM {table} WHERE {query}") -> str:
    """A rule as a query. template may use {fields}, {table}, {query}, {title}, {id}."""
    fields = ", ".join(f if re.search(r"[\s(]", f) else name(f) for f in rule.fields) or "*"
    values = {"fields": fields, "table": table, "query": predicate(rule), "title": rule.title, "id": rule.id or ""}
    return re.sub(r"\{(fields|table|query|title|id)\}", lambda m: values[m[1]], template)


def view(rule: Rule, table: str) -> str:
    """CREATE VIEW text, named after the rule's key."""
    return f"CREATE OR REPLACE TEMPORARY VIEW `{re.sub(r'[^A-Za-z0-9_]', '_', rule.key)}` AS {query(rule, table)}"


def _threshold(c: Correlation, value: str) -> str:
    return " AND ".join(f"{value} {_OPS[k]} {v!r}" for k, v in c.predicates)


def correlation(c: Correlation, rules: RuleSet, table: str, ts: str = "ts", grouped: bool = False) -> str:
    """A correlation as SQL over a table with a timestamp column.

    Sliding windows fire for each hit, over the trailing span in whole seconds; equal seconds count together. grouped
    gives the tumbling form: one row for each group and bucket. temporal counts distinct rules of a bucket. Sessions give
    one row each (first, last, value).
    """
    by = {r.key: r for r in rules.rules} | {r.name: r for r in rules.rules if r.name} | {r.title: r for r in rules.rules}
    used = [by[r] for r in c.rules if r in by]
    if len(used) != len(c.rules) or c.aliases or c.expression or c.type == "temporal_ordered":
        raise BadRule(f"no SQL text for correlation {c.key!r}")
    cols = "".join(f", {name(g)}" for g in c.group_by)
    value = name(c.value_fields[0]) if c.value_fields else ""
    hits = " UNION ALL ".join(f"SELECT {literal(r.key)} AS rule_key, unix_seconds(CAST({name(ts)} AS TIMESTAMP)) AS t{cols}{f', {value} AS v' if value else ''} FROM {table} WHERE {predicate(r)}" for r in used)
    keys = [name(g).rpartition(".")[2] for g in c.group_by]
    form: Callable[[str], str] = lambda a: a.format(v="v", p=c.percentile / 100)
    if c.window != "session" and (grouped or c.window == "tumbling" or c.type in ("temporal", "value_count")):
        a = "count(DISTINCT rule_key)" if c.type == "temporal" else "count(DISTINCT v)" if c.type == "value_count" else form(_AGGREGATES[c.type])
        bucket = f"t - pmod(t, {c.timespan})"
        return f"WITH h AS ({hits}) SELECT {', '.join([*keys, f'{bucket} AS bucket', f'{a} AS value'])} FROM h GROUP BY {', '.join([*keys, bucket])} HAVING {_threshold(c, a)}"
    if c.window == "session":
        # gaps and islands; a session longer than the span is left out, not split
        part = f"PARTITION BY {', '.join(keys)} " if keys else ""
        a = "count(DISTINCT rule_key)" if c.type == "temporal" else "count(DISTINCT v)" if c.type == "value_count" else form(_AGGREGATES[c.type])
        new = f"CASE WHEN t - lag(t) OVER ({part}ORDER BY t) > {c.gap} THEN 1 ELSE 0 END"
        sessions = f"g AS (SELECT *, {new} AS new FROM h), s AS (SELECT *, sum(new) OVER ({part}ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g)"
        return f"WITH h AS ({hits}), {sessions} SELECT {', '.join([*keys, 'min(t) AS first', 'max(t) AS last', f'{a} AS value'])} FROM s GROUP BY {', '.join([*keys, 'sid'])} HAVING max(t) - min(t) <= {c.timespan} AND {_threshold(c, a)}"
    over = f"({f'PARTITION BY {", ".join(keys)} ' if keys else ''}ORDER BY t RANGE BETWEEN {c.timespan} PRECEDING AND CURRENT ROW)"
    a = f"{form(_AGGREGATES[c.type])} OVER {over}"
    if c.type in ("value_sum", "value_avg"):
        a = f"coalesce({'sum' if c.type == 'value_sum' else 'avg'}(v) OVER {over}, 0)"
    return f"WITH h AS ({hits}), w AS (SELECT {', '.join([*keys, 't', f'{a} AS value'])} FROM h) SELECT * FROM w WHERE {_threshold(c, 'value')}"
