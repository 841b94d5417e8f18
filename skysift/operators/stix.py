"""STIX 2.1 patterns over observed objects, and traversal of relationship graphs.

Observations are rows (obs_id, ts, type, and the object's properties as columns). A comparison expression is a filter;
AND, OR and FOLLOWEDBY of observations are joins of bindings, which carry the ids and the time span of what they used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.functions.fields import Field, Resolver, number, text
from skysift.functions.literals import quote
from skysift.operators.matchers import _any, _cidr, sure

UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800, "MONTH": 2592000, "YEAR": 31536000}
_token = re.compile(r"\s*(t?'(?:[^'\\]|\\.)*'|h'[^']*'|b'[^']*'|!=|<=|>=|<>|[\[\]()=<>,]|[^\s\[\]()=<>!,']+(?:(?:'[^']*'|\[(?:\*|\d+)\])[^\s\[\]()=<>!,']*)*)")


class BadPattern(ValueError):
    """The text is no pattern."""


@dataclass
class Node:
    kind: str
    parts: list[Any] = field(default_factory=list)
    qualifiers: list[tuple] = field(default_factory=list)


def parse(pattern: str) -> Node:
    """FOLLOWEDBY binds loosest, then OR, then AND; qualifiers (WITHIN, REPEATS, START..STOP) follow an observation or a group."""
    tokens = _token.findall(pattern)
    if "".join(tokens).replace(" ", "") != re.sub(r"\s", "", pattern) and "'" not in pattern:
        raise BadPattern(pattern)
    at = 0

    def peek(n: int = 0) -> str:
        return tokens[at + n] if at + n < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or want is not None and tokens[at].upper() != want:
            raise BadPattern(f"expected {want or 'more'} at {' '.join(tokens[at : at + 3])!r}")
        at += 1
        return tokens[at - 1]

    def chain(word: str, inner) -> Node:
        parts = [inner()]
        while peek().upper() == word:
            take()
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Node(word.lower(), parts)

    def literal() -> Any:
        t = take()
        if t == "(":
            out = [literal()]
            while peek() == ",":
                take()
                out.append(literal())
            take(")")
            return out
        if t[:1] == "'":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if t[:2] in ("t'", "h'", "b'"):
            return t[2:-1]
        if t.lower() in ("true", "false"):
            return t.lower() == "true"
        return float(t) if "." in t else int(t)

    def comparison() -> Node:
        if peek() == "(":
            take()
            inner = either()
            take(")")
            return inner
        if peek().upper() == "EXISTS":
            take()
            return Node("exists", [take()])
        path = take()
        negated = peek().upper() == "NOT" and bool(take())
        op = take().upper()
        if op not in ("=", "!=", "<>", "<", ">", "<=", ">=", "IN", "LIKE", "MATCHES", "ISSUBSET", "ISSUPERSET"):
            raise BadPattern(f"unknown operator {op}")
        node = Node("test", [path, "!=" if op == "<>" else op, literal()])
        return Node("not", [node]) if negated else node

    def both() -> Node:
        return chain("AND", comparison)

    def either() -> Node:
        return chain("OR", both)

    def observation() -> Node:
        if peek() == "(":
            take()
            node = sequence()
            take(")")
            node = Node("group", [node])
        else:
            take("[")
            node = Node("observe", [either()])
            take("]")
        while peek().upper() in ("WITHIN", "REPEATS", "START"):
            word = take().upper()
            if word == "WITHIN":
                n = float(take())
                node.qualifiers.append(("within", n * UNITS[take().upper().rstrip("S")]))
            elif word == "REPEATS":
                node.qualifiers.append(("repeats", int(take())))
                take("TIMES")
            else:
                start = literal()
                take("STOP")
                node.qualifiers.append(("between", start, literal()))
        return node

    def all_of() -> Node:
        return chain("AND", observation)

    def any_of() -> Node:
        return chain("OR", all_of)

    def sequence() -> Node:
        return chain("FOLLOWEDBY", any_of)

    tree = sequence()
    if at != len(tokens):
        raise BadPattern(f"unexpected {tokens[at]!r}")
    return tree


def _like(pattern: str) -> str:
    return r"(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else quote(c) for c in pattern) + r"\z"


_ref_step = re.compile(r"^([A-Za-z0-9_-]+_refs?)(?:\[(?:\*|\d+)\])?\.")


def _find(rest: str, r: Resolver) -> Field | None:
    """A property path: names, quoted dictionary keys, indexes, `[*]`; `x_ref.y` and `x_refs[*].y` look into the
    column that dereferenced() has joined, falling back on what the observation itself nests there."""
    plain = re.sub(r"\[\*\]", "", rest)
    if m := _ref_step.match(rest):
        joined = r.find(f"{DEREF}{m[1]}" + re.sub(r"^[^.\[]+", "", plain).replace("'", ""))
        if joined is not None:
            return joined
    if "'" not in plain:
        return r.find(plain)
    # a quoted key may hold dots: its own step, with dots escaped
    return r.find(re.sub(r"'([^']*)'", lambda k: k[1].replace(".", "\\."), plain))


#: Prefix of the columns that hold referenced objects.
DEREF = "ref:"


def references(n: Node) -> set[str]:
    """Names of the reference properties that a pattern looks through."""
    if n.kind in ("test", "exists"):
        m = _ref_step.match(n.parts[0].partition(":")[2])
        return {m[1]} if m else set()
    return {x for p in n.parts if isinstance(p, Node) for x in references(p)}


def dereferenced(observations: DataFrame, objects: DataFrame, names: set[str], id_column: str, object_id: str = "id") -> DataFrame:
    """Adds for each x_ref the referenced object as a struct, for each x_refs an array of them; one equi-join a name.

    Of several objects with one id that with the greatest JSON text counts. A dangling reference is null, or no member.
    """
    whole = F.struct(*objects.columns)
    target = objects.groupBy(F.col(object_id).alias("__to")).agg(F.max_by(whole, F.to_json(whole)).alias("__object"))
    for name in sorted(names & set(observations.columns)):
        column = f"{DEREF}{name}"
        if name.endswith("_refs"):
            each = observations.select(F.col(id_column).alias("__of"), F.posexplode(name).alias("__at", "__ref"))
            found = each.join(target, F.col("__ref") == F.col("__to")).groupBy("__of").agg(F.collect_list(F.struct("__at", "__object")).alias("__all"))
            # in the order of the references; positions differ, so objects needn't be comparable
            found = found.select("__of", F.transform(F.array_sort("__all", lambda x, y: x["__at"] - y["__at"]), lambda x: x["__object"]).alias(column))
            observations = observations.join(found, F.col(id_column) == F.col("__of"), "left").drop("__of")
        else:
            observations = observations.join(target.withColumnRenamed("__object", column), F.col(name) == F.col("__to"), "left").drop("__to")
    return observations


def _test(path: str, op: str, value: Any, r: Resolver, kind: str | None) -> Column:
    name, _, rest = path.partition(":")
    f = _find(rest, r)
    if f is None:
        return F.lit(False)

    def one(x: Field) -> Column:
        if op == "IN":
            return reduce(lambda a, b: a | b, [equal(x, v) for v in value])
        if op in ("=", "!="):
            return equal(x, value) if op == "=" else ~equal(x, value)
        if op == "LIKE":
            return text(x).rlike(_like(value))
        if op == "MATCHES":
            return text(x).rlike(value)
        if op in ("ISSUBSET", "ISSUPERSET"):
            return sure(_cidr(value)(text(x)))
        a, b = (number(x), F.lit(float(value))) if not isinstance(value, str) else (text(x), F.lit(value))
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def equal(x: Field, v: Any) -> Column:
        if isinstance(v, bool):
            return x.column == v if isinstance(x.type, T.BooleanType) else F.lower(text(x)) == str(v).lower()
        return number(x) == float(v) if isinstance(v, (int, float)) else text(x) == v

    same = (F.col("type") == name) if kind is None else F.lit(kind == name)
    return same & sure(_any(f, one))


def _matches(n: Node, r: Resolver) -> Column:
    if n.kind == "test":
        return _test(*n.parts, r, None)
    if n.kind == "not":
        inner = n.parts[0].parts[0].partition(":")[0]
        return (F.col("type") == inner) & ~_matches(n.parts[0], r)
    if n.kind == "exists":
        name, _, rest = n.parts[0].partition(":")
        f = _find(rest, r)
        return F.lit(False) if f is None else (F.col("type") == name) & f.column.isNotNull()
    return reduce((lambda a, b: a & b) if n.kind == "and" else (lambda a, b: a | b), [_matches(p, r) for p in n.parts])


def bindings(pattern: str | Node, observations: DataFrame, by: list[str] = (), id_column: str = "obs_id", ts: str = "ts", objects: DataFrame | None = None) -> DataFrame:
    """Rows (by..., ids array, first, last): each way the pattern is met by distinct observations.

    `by` partitions the observations (a host, say), which turns the joins into equi-joins; without it a compound
    pattern is a join over all matching observations. Paths through references (`from_ref.value`) look into `objects`,
    rows with a column `id`; the observations themselves, if they have one, unless told otherwise.
    """
    tree = parse(pattern) if isinstance(pattern, str) else pattern
    source = objects if objects is not None else observations if "id" in observations.columns else None
    if source is not None and (names := references(tree)):
        observations = dereferenced(observations, source, names, id_column)
    r = Resolver(observations.schema)
    keys = list(by)

    def join(a: DataFrame, b: DataFrame, extra) -> DataFrame:
        b = b.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("ids").alias("ids2"), F.col("first").alias("f2"), F.col("last").alias("l2"))
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], ~F.arrays_overlap("ids", "ids2") & extra)
        j = a.join(b, on)
        return j.select(*keys, F.array_sort(F.concat("ids", "ids2")).alias("ids"), F.least("first", "f2").alias("first"), F.greatest("last", "l2").alias("last")).distinct()

    def qualified(df: DataFrame, n: Node) -> DataFrame:
        for q in n.qualifiers:
            if q[0] == "within":
                df = df.where(F.col("last") - F.col("first") <= q[1])
            elif q[0] == "between":
                start, stop = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in q[1:])
                df = df.where((F.col("first") >= start) & (F.col("last") < stop))
        return df

    def run(n: Node) -> DataFrame:
        if n.kind == "observe":
            df = observations.where(_matches(n.parts[0], r)).select(*keys, F.array(F.col(id_column)).alias("ids"), F.col(ts).alias("first"), F.col(ts).alias("last"))
        elif n.kind == "group":
            df = run(n.parts[0])
        elif n.kind == "or":
            return reduce(DataFrame.union, [run(p) for p in n.parts]).distinct()
        else:
            ordered = n.kind == "followedby"
            return reduce(lambda a, b: join(a, b, F.col("last") <= F.col("f2") if ordered else F.lit(True)), [run(p) for p in n.parts])
        if times := next((q[1] for q in n.qualifiers if q[0] == "repeats"), None):
            within = next((q[1] for q in n.qualifiers if q[0] == "within"), None)
            from pyspark.sql import Window

            w = Window.partitionBy(*keys).orderBy("first", "ids")
            frame = w.rowsBetween(-(times - 1), 0)
            runs = df.withColumn("__ids", F.flatten(F.collect_list("ids").over(frame))).withColumn("__f", F.min("first").over(frame)).where(F.size("__ids") == times)
            df = runs.select(*keys, F.array_sort("__ids").alias("ids"), F.col("__f").alias("first"), "last")
            df = df if within is None else df.where(F.col("last") - F.col("first") <= within)
        return qualified(df, n)

    return run(tree)


def edges(objects: DataFrame) -> DataFrame:
    """Rows (src, kind, dst): relationship objects, and created_by_ref of any object."""
    rel = objects.where("type = 'relationship'").select(F.col("source_ref").alias("src"), F.col("relationship_type").alias("kind"), F.col("target_ref").alias("dst"))
    if "created_by_ref" in objects.columns:
        rel = rel.union(objects.where("created_by_ref IS NOT NULL").select(F.col("id"), F.lit("created-by"), F.col("created_by_ref")))
    return rel


def expand(links: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] = (), both_ways: bool = True) -> DataFrame:
    """Rows (node, depth): breadth-first from seeds(node), up to a depth; one join a level."""
    e = links.where(F.col("kind").isin(list(kinds))) if kinds else links
    hops = e.select("src", "dst").union(e.select(F.col("dst"), F.col("src"))) if both_ways else e.select("src", "dst")
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen


def dangling(links: DataFrame, objects: DataFrame) -> DataFrame:
    """References to objects that aren't there."""
    refs = links.select(F.explode(F.array("src", "dst")).alias("ref")).distinct()
    return refs.join(objects.select(F.col("id").alias("ref")), "ref", "left_anti")


def search(objects: DataFrame, types: list[str] = (), modified_after: str | None = None, labels: list[str] = (), words: str | None = None, limit: int | None = None, after: str | None = None) -> DataFrame:
    """The newest version of each object under the filters, by id; `after` is the cursor of the page before."""
    newest = objects.groupBy("id").agg(F.max_by(F.struct(*objects.columns), "modified").alias("o")).select("o.*")
    if types:
        newest = newest.where(F.col("type").isin(list(types)))
    if modified_after:
        newest = newest.where(F.col("modified") > modified_after)
    if labels:
        newest = newest.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    if words:
        newest = newest.where(F.contains(F.lower("name"), F.lit(words.lower())))
    if after:
        newest = newest.where(F.col("id") > after)
    out = newest.orderBy("id")
    return out.limit(limit) if limit else out
