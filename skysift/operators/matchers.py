"""Detection trees -> Boolean columns.

Leaves are left null where a field is absent, so that positive conjuncts stay plain comparisons that reach the scan;
nulls become false only beneath a negation, in counts and at the end.
"""

from __future__ import annotations

import ipaddress
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.functions import literals
from skysift.functions.fields import Field, Resolver, epoch, lower, number, text
from skysift.plans import conditions
from skysift.plans.rules import BadRule, Detection, Item

PARTS = {"minute": F.minute, "hour": F.hour, "day": F.dayofmonth, "week": F.weekofyear, "month": F.month, "year": F.year}
COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
WIDE = ("wide", "utf16le", "utf16be", "utf16")
KNOWN = {"contains", "startswith", "endswith", "all", "cased", "re", "i", "m", "s", "cidr", "neq", "exists", "fieldref", "expand", "base64", "base64offset", "windash", *WIDE, *COMPARE, *PARTS}
#: From so many plain needles on, one alternation replaces an OR of substring searches.
MANY = 8


def sure(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def check(mods: list[str]) -> None:
    """Refuse unknown modifiers and pairs that contradict each other."""
    if unknown := [m for m in mods if m not in KNOWN]:
        raise BadRule(f"unknown modifier {unknown[0]!r}")
    have = set(mods)
    if len(have & {"contains", "startswith", "endswith"}) > 1:
        raise BadRule("contains, startswith and endswith exclude each other")
    if len(have & set(COMPARE)) > 1 or have & set(COMPARE) and have & {"contains", "startswith", "endswith", "re", "cidr"}:
        raise BadRule("a comparison can't be combined with another matcher")
    if "re" in have and have & {"contains", "startswith", "endswith", "cidr", "base64", "base64offset", "windash"}:
        raise BadRule("re can't be combined with a string matcher")
    if have & {"i", "m", "s"} and "re" not in have:
        raise BadRule("regular-expression flags need re")
    if len(have & set(PARTS)) > 1 or len(have & set(WIDE)) > 1 or {"base64", "base64offset"} <= have:
        raise BadRule("modifiers exclude each other")


def _any(f: Field, test) -> Column:
    """test(field) for a scalar, or for any member of an array."""
    return F.exists(f.column, lambda x: test(f.element(x))) if f.is_array else test(f)


def strings(value: Any, mods: list[str]) -> tuple[list[str], bool]:
    """Literal rewriting of a value: the variants to search for, and whether they must be searched as substrings."""
    s = str(value)
    out = [s]
    if "windash" in mods:
        out = literals.dash_variants(s)
    wide = next((m for m in mods if m in WIDE), None)
    raw = [literals.utf16(x, wide) if wide else x.encode() for x in out]
    if "base64" in mods:
        return [literals.base64_text(x) for x in raw], False
    if "base64offset" in mods:
        return [y for x in raw for y in literals.base64_offsets(x)], True
    return out, False


def _string_test(value: Any, mods: list[str]):
    """A test of a Field's text for one value."""
    cased = "cased" in mods
    mode = next((m for m in ("contains", "startswith", "endswith") if m in mods), None)
    variants, inside = strings(value, mods)
    mode = "contains" if inside else mode
    encoded = "base64" in mods or "base64offset" in mods

    def one(s: str):
        parts = [s] if encoded else literals.wildcard_parts(s)
        if all(isinstance(p, str) for p in parts):
            plain = "".join(parts)
            needle = plain if cased else plain.lower()
            fold = text if cased else lower
            return {
                None: lambda f: fold(f) == needle,
                "contains": lambda f: F.contains(fold(f), F.lit(needle)),
                "startswith": lambda f: F.startswith(fold(f), F.lit(needle)),
                "endswith": lambda f: F.endswith(fold(f), F.lit(needle)),
            }[mode]
        pattern = literals.wildcard_regex(parts, mode not in ("contains", "endswith"), mode not in ("contains", "startswith"), not cased)
        return lambda f: text(f).rlike(pattern)

    tests = [one(v) for v in variants]
    return lambda f: reduce(lambda a, b: a | b, [t(f) for t in tests])


def _cidr(value: str):
    net = ipaddress.ip_network(str(value), strict=False)
    if net.version == 4:
        low, high = int(net.network_address), int(net.broadcast_address)

        def four(c: Column) -> Column:
            parts = F.split(c, r"\.")
            n = reduce(lambda a, b: a * 256 + b, [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)])
            return F.when(c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), n.between(low, high))

        return four
    bits = f"{int(net.network_address):0128b}"[: net.prefixlen]

    @F.pandas_udf("boolean")
    def six(s):
        def inside(x):
            try:
                a = ipaddress.ip_address(x)
            except (ValueError, TypeError):
                return False
            return a.version == 6 and f"{int(a):0128b}".startswith(bits)

        return s.map(inside)

    return six


def _regex(pattern: str, mods: list[str]) -> str:
    """A user's pattern under Unicode classes; look-around and back-references are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise BadRule(f"look-around and back-references aren't supported: {pattern!r}")
    return f"(?dU{'iu' if 'i' in mods else ''}{'m' if 'm' in mods else ''}{'s' if 's' in mods else ''})" + pattern


def _expanded(value: str, resolver: Resolver) -> Column:
    parts = re.split(r"%([^%]+)%", str(value))
    cols = []
    for n, p in enumerate(parts):
        if n % 2:
            f = resolver.find(p)
            cols.append(F.coalesce(text(f), F.lit("")) if f is not None and not f.is_array else F.lit(""))
        elif p:
            cols.append(F.lit(p))
    return F.concat(*cols) if cols else F.lit("")


def _test(value: Any, mods: list[str], resolver: Resolver):
    """A test of a scalar Field for one value, in order of precedence."""
    if "expand" in mods:
        mode = next((m for m in ("contains", "startswith", "endswith") if m in mods), None)
        fold = (lambda c: c) if "cased" in mods else F.lower
        want = fold(_expanded(value, resolver))
        op = {None: lambda a, b: a == b, "contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[mode]
        return lambda f: op(fold(text(f)), want)
    if part := next((m for m in mods if m in PARTS), None):
        return lambda f: PARTS[part](F.timestamp_seconds(epoch(f))) == int(value)
    if "fieldref" in mods:
        other = resolver.find(str(value))
        if other is None:
            return lambda f: F.lit(False)
        op = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}.get(next((m for m in ("contains", "startswith", "endswith") if m in mods), ""), lambda a, b: a == b)
        numeric = lambda a, b: isinstance(a.type, T.NumericType) and isinstance(b.type, T.NumericType)
        return lambda f: (f.column == other.column) if numeric(f, other) else op(F.lower(text(f)), F.lower(text(other)))
    if "re" in mods:
        pattern = _regex(str(value), mods)
        return lambda f: text(f).rlike(pattern)
    if "cidr" in mods:
        inside = _cidr(value)
        return lambda f: inside(text(f))
    if op := next((m for m in mods if m in COMPARE), None):
        return lambda f: COMPARE[op](number(f), F.lit(float(value)))
    if isinstance(value, bool):
        yes = ["true", "1", "yes"] if value else ["false", "0", "no"]
        return lambda f: f.column == F.lit(value) if isinstance(f.type, T.BooleanType) else F.lower(text(f)).isin(yes)
    if isinstance(value, (int, float)) and not set(mods) & {"contains", "startswith", "endswith", "base64", "base64offset"}:
        exact = isinstance(value, int)
        return lambda f: f.column == F.lit(value) if exact and isinstance(f.type, T.IntegralType) else number(f) == F.lit(float(value))
    return _string_test(value, mods)


def _keyword(value: Any, mods: list[str], resolver: Resolver) -> Column:
    """Any string leaf contains the text; numbers and nulls match nothing."""
    if not isinstance(value, str):
        return F.lit(False)
    test = _string_test(value, [*mods, "contains"] if not set(mods) & {"contains", "startswith", "endswith", "re"} else mods)
    if "re" in mods:
        pattern = _regex(value, mods)
        test = lambda f: text(f).rlike(pattern)
    leaves = [sure(_any(f, test)) for f in resolver.leaves()]
    return reduce(lambda a, b: a | b, leaves, F.lit(False))


def item(it: Item, resolver: Resolver) -> Column:
    """One item as a column: null or false where it doesn't match."""
    mods = it.modifiers
    check(mods)
    if it.field is None:
        if "exists" in mods:
            return F.lit(not _truth(it.values[0]))
        words = [_keyword(v, mods, resolver) for v in it.values]
        return reduce((lambda a, b: a & b) if "all" in mods else (lambda a, b: a | b), words)
    f = resolver.find(it.field)
    if it.quantifier:
        return _quantified(it, f)
    if "exists" in mods:
        found = F.lit(False) if f is None else f.column.isNotNull()
        return found if _truth(it.values[0]) else ~found
    if "all" in mods and len(it.values) < 2:
        raise BadRule(f"{it.field}|all needs two values or more")
    rest = [m for m in mods if m not in ("all", "neq")]
    tests = []
    for v in it.values:
        if v is None:
            test = F.lit(True) if f is None else f.column.isNull() if not isinstance(f.type, T.VariantType) else f.column.isNull() | F.is_variant_null(f.column)
            tests.append(~test if "neq" in mods else test)
        elif f is None:
            tests.append(F.lit(False))
        else:
            inner = _any(f, _test(v, rest, resolver))
            tests.append(f.column.isNotNull() & ~sure(inner) if "neq" in mods else inner)
    if "all" in mods:
        return reduce(lambda a, b: a & b, tests)
    plain = f is not None and not rest and not f.is_array and isinstance(f.type, T.StringType) and "neq" not in mods and len(it.values) > 1
    if plain and all(isinstance(v, str) and all(isinstance(p, str) for p in literals.wildcard_parts(v)) for v in it.values):
        return lower(f).isin([("".join(literals.wildcard_parts(v))).lower() for v in it.values])
    if f is not None and rest == ["contains"] and len(it.values) >= MANY and "neq" not in mods and all(isinstance(v, str) and all(isinstance(p, str) for p in literals.wildcard_parts(v)) for v in it.values):
        needles = "|".join(literals.quote("".join(literals.wildcard_parts(v)).lower()) for v in it.values)
        return _any(f, lambda x: F.lower(text(x)).rlike(f"(?:{needles})"))
    return reduce(lambda a, b: a | b, tests)


def _truth(v: Any) -> bool:
    return v if isinstance(v, bool) else str(v).lower() not in ("false", "no", "0")


def _quantified(it: Item, f: Field | None) -> Column:
    """field[any|all|all_or_empty|none]: values or a nested block, over members; a scalar is an array of one."""
    kind = it.quantifier
    if f is None:
        return F.lit(kind in ("none", "all_or_empty"))
    array = f.column if f.is_array else F.when(f.column.isNotNull(), F.array(f.column))
    element = f.type.elementType if f.is_array else f.type

    def member(x: Column) -> Column:
        if it.block is not None:
            if not isinstance(element, T.StructType):
                return F.lit(False)
            return sure(detection(it.block, Resolver(element, x)))
        values = Item("value", [m for m in it.modifiers], it.values)
        one = Resolver(T.StructType([T.StructField("value", element)]), None)
        one._top = lambda name: x  # the member itself
        return sure(item(values, one))

    some = F.exists(array, member)
    if kind == "any":
        return some
    if kind == "none":
        return ~sure(some)
    every = F.forall(array, member)
    return (F.size(array) > 0) & every if kind == "all" else F.coalesce(every, F.lit(True))


def detection(d: Detection, resolver: Resolver) -> Column:
    if d.named:
        return condition(d.condition, d.named, resolver)
    parts = [item(i, resolver) for i in d.items]
    if d.any_of:
        parts.append(reduce(lambda a, b: a | b, [detection(x, resolver) for x in d.any_of]))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def condition(source: str, detections: dict[str, Detection], resolver: Resolver) -> Column:
    def count(leaves: list[Column], n: int) -> Column:
        if n <= 0:
            return F.lit(True)
        if n > len(leaves):
            return F.lit(False)
        if n == 1:
            return reduce(lambda a, b: a | b, leaves)
        if n == len(leaves):
            return reduce(lambda a, b: a & b, leaves)
        return reduce(lambda a, b: a + b, [sure(x).cast("int") for x in leaves]) >= n

    return conditions.fold(
        conditions.parse(source), list(detections), lambda n: detection(detections[n], resolver), lambda c: ~sure(c),
        lambda cs: reduce(lambda a, b: a & b, cs), lambda cs: reduce(lambda a, b: a | b, cs), count,
    )
