"""Recognising, routing, observing and discovering event schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.functions.fields import Resolver, number, text
from skysift.operators.matchers import COMPARE, sure


#: Distinct shapes met at a time by discovery; characters of a value that may mark a schema.
LEADERS, MARKER = 500, 64


@dataclass
class Signature:
    """A schema's name and predicates: dicts with one of present, absent, any_of, equals, matches, compare, in, same, not, any, all, has_any."""

    name: str
    predicates: list[dict[str, Any]]
    specificity: int = 0
    mapping: dict[str, str] = field(default_factory=dict)

    @property
    def weight(self) -> int:
        return self.specificity or len(self.predicates)


def holds(p: dict[str, Any], r: Resolver) -> Column:
    """One predicate as a column; absent fields are false but for `absent` and `not`."""
    (kind, v), = p.items()
    value = lambda n: (f := r.find(n)) and text(f)
    here = lambda n: F.lit(False) if r.find(n) is None else r.find(n).column.isNotNull()
    both = lambda op: lambda xs: reduce(op, [sure(holds(x, r)) for x in xs])
    if kind == "present":
        return here(v)
    if kind == "absent":
        return ~here(v)
    if kind in ("any_of", "has_any"):
        return reduce(lambda a, b: a | b, [here(n) for n in v])
    if kind == "not":
        return ~sure(holds(v, r))
    if kind == "any":
        return both(lambda a, b: a | b)(v)
    if kind == "all":
        return both(lambda a, b: a & b)(v)
    if kind == "same":
        a, b = value(v[0]), value(v[1])
        return F.lit(False) if a is None or b is None else sure(a == b)
    name, want = v["field"], v["value"]
    f = r.find(name)
    if f is None:
        return F.lit(False)
    if kind == "equals":
        return sure(text(f) == str(want))
    if kind == "matches":
        return sure(text(f).rlike(want))
    if kind == "in":
        return sure(text(f).isin([str(x) for x in want]))
    if kind == "compare":
        return sure(COMPARE[v["op"]](number(f), F.lit(float(want))))
    raise ValueError(f"unknown predicate {kind!r}")


def _signs(df: DataFrame, signatures: list[Signature]) -> list[tuple[Signature, Column]]:
    r = Resolver(df.schema)
    ranked = sorted(signatures, key=lambda s: (-s.weight, s.name))
    return [(s, reduce(lambda a, b: a & b, [sure(holds(p, r)) for p in s.predicates])) for s in ranked]


def classify(df: DataFrame, signatures: list[Signature]) -> DataFrame:
    """Adds schema (highest specificity, then name), schemas (all that hold) and ambiguous (a tie at the top)."""
    signs = _signs(df, signatures)
    names = F.array_compact(F.array(*(F.when(c, F.lit(s.name)) for s, c in signs)))
    weights = F.array_compact(F.array(*(F.when(c, F.lit(s.weight)) for s, c in signs)))
    out = df.withColumn("schemas", names).withColumn("__w", weights)
    return out.withColumn("schema", F.get("schemas", F.lit(0))).withColumn("ambiguous", F.coalesce(F.get("__w", F.lit(0)) == F.get("__w", F.lit(1)), F.lit(False))).drop("__w")


def route(df: DataFrame, signatures: list[Signature]) -> DataFrame:
    """Common columns from each schema's own: mapping common -> path, by the classified schema."""
    named = classify(df, signatures)
    r = Resolver(df.schema)
    for target in dict.fromkeys(t for s in signatures for t in s.mapping):
        col: Column = F.lit(None).cast("string")
        for s in signatures:
            if (f := r.find(s.mapping.get(target, ""))) is not None:
                col = F.when(F.col("schema") == s.name, text(f)).otherwise(col)
        named = named.withColumn(target, col)
    return named


@F.pandas_udf(T.ArrayType(T.StringType()))
def _walk(texts: pd.Series) -> pd.Series:
    import json

    def paths(text: str | None) -> list[str] | None:
        try:
            top = json.loads(text) if text is not None else None
        except ValueError:
            return None
        found, todo = {}, [("", top)] if isinstance(top, (dict, list)) else []
        while todo:
            path, value = todo.pop()
            if isinstance(value, dict):
                todo += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
            elif isinstance(value, list):
                # members of an array stand at the array's own path; an empty or scalar array is a leaf
                todo += [(path, v) for v in value if isinstance(v, (dict, list))]
                if path and not all(isinstance(v, (dict, list)) for v in value) or path and not value:
                    found[path] = True
            elif path:
                found[path] = True
        return sorted(found)

    return texts.map(paths)


def leaf_paths(event: Column) -> Column:
    """Distinct dotted paths of the scalar leaves of a JSON text column, at any depth, arrays entered.

    An Arrow UDF: built-in functions list one level of keys, and a walk of unknown depth can't be unrolled. Null or
    invalid text has none.
    """
    return F.coalesce(_walk(event), F.array().cast("array<string>"))


def observe(df: DataFrame, event: str) -> DataFrame:
    """Rows (field, n): events in which each leaf path of a JSON text column occurs."""
    return df.select(F.explode_outer(leaf_paths(F.col(event))).alias("field")).where("field IS NOT NULL").groupBy("field").agg(F.count("*").alias("n"))


def coverage(observed: DataFrame, known: list[str]) -> DataFrame:
    """Rows (field, state): missing = used by rules, never seen; unknown = seen, used by none; used = both."""
    spark = observed.sparkSession
    rules = spark.createDataFrame([(k,) for k in known], "rule_field string")
    both = observed.join(rules, F.col("field") == F.col("rule_field"), "full_outer")
    state = F.when(F.col("field").isNull(), "missing").when(F.col("rule_field").isNull(), "unknown").otherwise("used")
    return both.select(F.coalesce("field", "rule_field").alias("field"), state.alias("state"))


def shapes(df: DataFrame, event: str) -> DataFrame:
    """Rows (shape, n): sets of leaf paths and how many events have them."""
    return df.groupBy(F.array_sort(leaf_paths(F.col(event))).alias("shape")).agg(F.count("*").alias("n"))


def discover(df: DataFrame, event: str, similar: float = 0.6, core: float = 0.9, support: int = 3, top: int = 20, markers: int = 8) -> list[Signature]:
    """Signatures for unknown shapes, clustered by Jaccard similarity of their leaf paths.

    Leaders are chosen greedily, most frequent shape first: a shape unlike all leaders so far leads a cluster. Distinct
    shapes are met in bounded blocks in that order; a block keeps only what no earlier leader takes, so every shape of the
    data is placed, and the driver holds leaders and one block. A cluster's core fields are those of `core` of its
    events; a core field with at most `markers` distinct short values becomes an `in` predicate, and comes first; others are `present`. Three predicates at most; clusters of fewer than `support` events are left out.
    """
    counted = shapes(df, event).where(F.size("shape") > 0)
    leaders: list[list[str]] = []
    near = lambda lead, shape: F.size(F.array_intersect(lead, shape)) >= similar * F.size(F.array_union(lead, shape))
    known = lambda: F.array(*(F.array(*map(F.lit, x)) for x in leaders))
    rest = counted
    while block := rest.orderBy(F.desc("n"), "shape").limit(LEADERS).collect():
        for r in block:
            s = set(r["shape"])
            if not any(len(s & set(x)) >= similar * len(s | set(x)) for x in leaders):
                leaders.append(sorted(s))
        rest = counted.where(~F.exists(known(), lambda x: near(x, F.col("shape"))))
    if not leaders:
        return []
    of = lambda shape: F.array_position(F.transform(known(), lambda x: near(x, shape)), True)
    placed = df.select(F.col(event).alias("event"), F.array_sort(leaf_paths(F.col(event))).alias("shape")).where(F.size("shape") > 0).withColumn("lead", of(F.col("shape")))
    sizes = placed.groupBy("lead").agg(F.count("*").alias("total")).where(F.col("total") >= support).orderBy(F.desc("total"), "lead").limit(top).collect()
    big = placed.where(F.col("lead").isin([r["lead"] for r in sizes]))
    value = F.call_function("get_json_object", F.col("event"), F.concat(F.lit("$."), F.col("field")))
    values = big.select("lead", "event", F.explode("shape").alias("field")).groupBy("lead", "field", value.alias("value")).agg(F.count("*").alias("n"))
    fields = values.groupBy("lead", "field").agg(F.sum("n").alias("n"), F.count("value").alias("distinct"), F.count_if(F.col("value").isNull()).alias("odd"), F.slice(F.sort_array(F.collect_set(F.when(F.length("value") <= MARKER, F.col("value")))), 1, markers + 1).alias("some")).collect()
    out = []
    for k, r in enumerate(sizes):
        mine = [f for f in fields if f["lead"] == r["lead"] and f["n"] >= core * r["total"]]
        marked = lambda f: 1 <= f["distinct"] <= markers and not f["odd"] and len(f["some"]) == f["distinct"]
        mine.sort(key=lambda f: (not marked(f), f["distinct"] if marked(f) else 0, f["field"]))
        predicates = [{"in": {"field": f["field"], "value": list(f["some"])}} if marked(f) else {"present": f["field"]} for f in mine[:3]]
        if predicates:
            out.append(Signature(f"discovered_{k}", predicates))
    return out
