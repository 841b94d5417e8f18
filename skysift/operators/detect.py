"""Many rules over one scan: detections as rows.

Every rule is one Boolean column of the same projection; fired rules are gathered into an array and exploded, so the
cost of the output follows the matches, not events times rules. Rules are evaluated in chunks to keep generated code small.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.fields import Resolver, text
from skysift.operators.matchers import condition, detection, item, sure
from skysift.plans import conditions
from skysift.plans.rules import BadRule, Detection, Item, Rule, RuleSet, apply_filters

CHUNK = 100
#: Keyword hits reported for an event at most, as the rule language says.
KEYWORDS = 16


def routed(rule: Rule, resolver: Resolver) -> Column | None:
    """Conflict-based log-source routing: skip only where both sides name a value and they differ."""
    tests = []
    for part in ("product", "category", "service"):
        f = resolver.find(part)
        if (want := rule.logsource.get(part)) and f is not None:
            tests.append(F.coalesce(F.lower(text(f)) == want.lower(), F.lit(True)))
    return reduce(lambda a, b: a & b, tests) if tests else None


def matches(rule: Rule, df: DataFrame, route: bool = False, resolver: Resolver | None = None) -> Column:
    """Whether a rule fires; several conditions are alternatives. May be null for false: filter() on it."""
    resolver = resolver or Resolver(df.schema)
    fired = reduce(lambda a, b: a | b, [condition(c, rule.detections, resolver) for c in rule.conditions])
    where = routed(rule, resolver) if route else None
    return fired if where is None else where & fired


def selections(rule: Rule, df: DataFrame) -> Column:
    """Names of the true detections that the first true condition mentions."""
    resolver = Resolver(df.schema)
    out: Column = F.array().cast("array<string>")
    for c in reversed(rule.conditions):
        tree = conditions.parse(c)
        used = [n for n in rule.detections if n in _mentioned(tree, list(rule.detections))]
        names = F.array_compact(F.array(*(F.when(sure(detection(rule.detections[n], resolver)), F.lit(n)) for n in used)))
        out = F.when(sure(condition(c, rule.detections, resolver)), names).otherwise(out)
    return out


def matched_fields(rule: Rule, df: DataFrame) -> Column:
    """array<struct<field, value>>: of the detections that are true, each named field with its value as text, and up to
    KEYWORDS keyword hits as (keyword, text). Arrays give the members' JSON."""
    resolver = Resolver(df.schema)
    empty = F.array().cast("array<struct<field:string,value:string>>")
    parts: list[Column] = []
    for name, d in rule.detections.items():
        held = sure(detection(d, resolver))
        for it in _leaves(d):
            if it.field is None:
                words = [F.when(held & sure(item(Item(None, it.modifiers, [v], it.quantifier, it.block), resolver)), F.struct(F.lit("keyword").alias("field"), F.lit(str(v)).alias("value"))) for v in it.values]
                parts.append(F.slice(F.array_compact(F.array(*words)), 1, KEYWORDS))
            elif (f := resolver.find(it.field)) is not None:
                value = F.to_json(f.column) if f.is_array else text(f)
                one = F.struct(F.lit(it.field).alias("field"), value.alias("value"))
                parts.append(F.when(held & sure(item(it, resolver)), F.array(one)).otherwise(empty))
    return F.array_distinct(F.concat(empty, *parts))


def _leaves(d: Detection) -> list[Item]:
    return [*d.items, *(i for x in [*d.any_of, *d.named.values()] for i in _leaves(x))]


def _mentioned(tree: tuple, names: list[str]) -> set[str]:
    if tree[0] == "name":
        return {tree[1]}
    if tree[0] == "of":
        return set(conditions.selected(tree[2], names))
    return _mentioned(tree[1], names) if tree[0] == "not" else {n for t in tree[1] for n in _mentioned(t, names)}


def explain(rule: Rule, df: DataFrame) -> DataFrame:
    """The events with a struct column `explain`: the value of each detection, and `fired`."""
    resolver = Resolver(df.schema)
    parts = [sure(detection(d, resolver)).alias(n) for n, d in rule.detections.items()]
    return df.withColumn("explain", F.struct(*parts, sure(matches(rule, df)).alias("fired")))


def evaluate(rules: RuleSet, df: DataFrame, route: bool = False, keep: list[str] | None = None, detail: bool = False) -> DataFrame:
    """Rows (kept columns, rule_key, rule_title, rule_id, level, tags[, matched_selections]), one for each event and fired rule."""
    ready = apply_filters(rules).rules
    if len({r.key for r in ready}) != len(ready):
        raise BadRule("two rules share a key")
    keep = df.columns if keep is None else keep
    meta = lambda r: [F.lit(r.key).alias("rule_key"), F.lit(r.title).alias("rule_title"), F.lit(r.id).cast("string").alias("rule_id"), F.lit(r.level).cast("string").alias("level"), F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags")]
    if not ready:
        raise BadRule("no rules")
    if len(ready) == 1:
        return df.where(matches(ready[0], df, route)).select(*keep, *meta(ready[0]), *([selections(ready[0], df).alias("matched_selections")] if detail else []))
    # rules are numbers until they have fired: building their descriptions for each event costs more than the matching
    shared = Resolver(df.schema)
    number = lambda k, r: F.struct(F.lit(k).alias("rule"), selections(r, df).alias("matched_selections")) if detail else F.lit(k)
    fired = []
    for k in range(0, len(ready), CHUNK):
        fired.append(F.array_compact(F.array(*(F.when(matches(r, df, route, shared), number(k + i, r)) for i, r in enumerate(ready[k : k + CHUNK])))))
    hits = fired[0] if len(fired) == 1 else F.concat(*fired)
    # outer: explode would make the optimizer evaluate every rule a second time in an inferred filter
    found = df.select(*keep, F.explode_outer(hits).alias("__hit")).where("__hit IS NOT NULL")
    of = F.col("__hit.rule") if detail else F.col("__hit")
    # a constant, folded once
    about = json.dumps([{"rule_key": r.key, "rule_title": r.title, "rule_id": r.id, "level": r.level, "tags": r.tags} for r in ready])
    known = F.from_json(F.lit(about), "array<struct<rule_key:string,rule_title:string,rule_id:string,level:string,tags:array<string>>>")
    more = [F.col("__hit.matched_selections").alias("matched_selections")] if detail else []
    return found.select(*keep, F.get(known, of).alias("__rule"), *more).select(*keep, "__rule.*", *(["matched_selections"] if detail else []))
