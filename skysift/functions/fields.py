"""Field paths -> typed columns of an events DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Field:
    """A resolved field: its column and type. Arrays mean any-member matching. None stands for an absent field."""

    column: Column
    type: T.DataType
    #: Derived columns of this field, made once: text, number, lower-cased text. Making a column is a call to the JVM.
    made: dict[str, Column] = field(default_factory=dict, repr=False)

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    def element(self, x: Column) -> Field:
        return Field(x, self.type.elementType)


_step = re.compile(r"((?:\\.|[^.\[\]\\])+)((?:\[-?\d+\])*)")


def steps(path: str) -> list[tuple[str, list[int]]]:
    """`a.b[0].c` -> [("a", []), ("b", [0]), ("c", [])]; brackets may be escaped."""
    return [(re.sub(r"\\(.)", r"\1", m[1]), [int(i) for i in re.findall(r"\[(-?\d+)\]", m[2])]) for m in _step.finditer(path)]


def _child(f: Field, name: str) -> Field | None:
    t = f.type
    if isinstance(t, T.StructType):
        hit = next((x for x in t.fields if x.name == name), None)
        return hit and Field(f.column[name], hit.dataType)
    if isinstance(t, T.MapType):
        return Field(f.column[name], t.valueType)
    if isinstance(t, T.VariantType):
        return Field(F.try_variant_get(f.column, f'$["{name}"]', "variant"), t)
    if isinstance(t, T.ArrayType):
        inner = _child(Field(F.lit(None), t.elementType), name)
        if inner is None:
            return None
        spread = F.transform(f.column, lambda x: _child(Field(x, t.elementType), name).column)
        return Field(F.flatten(spread), inner.type) if isinstance(inner.type, T.ArrayType) else Field(spread, T.ArrayType(inner.type))
    return None


def _nth(f: Field, i: int) -> Field | None:
    if isinstance(f.type, T.ArrayType):
        return Field(F.get(f.column, F.lit(i) if i >= 0 else F.size(f.column) + i), f.type.elementType)
    if isinstance(f.type, T.VariantType) and i >= 0:
        return Field(F.try_variant_get(f.column, f"$[{i}]", "variant"), f.type)
    return None


class Resolver:
    """Names are case-sensitive. A column whose own name is the dotted path wins over a nested one."""

    def __init__(self, schema: T.StructType, base: Column | None = None):
        self.schema, self.base, self.found = schema, base, {}

    def find(self, path: str) -> Field | None:
        if path not in self.found:
            self.found[path] = self._find(path)
        return self.found[path]

    def _find(self, path: str) -> Field | None:
        whole = next((x for x in self.schema.fields if x.name == path), None)
        if whole is not None:
            return Field(self._top(path), whole.dataType)
        found: Field | None = None
        for n, (name, indexes) in enumerate(steps(path)):
            if n == 0:
                top = next((x for x in self.schema.fields if x.name == name), None)
                found = top and Field(self._top(name), top.dataType)
            else:
                found = _child(found, name)
            for i in indexes:
                found = found and _nth(found, i)
            if found is None:
                return None
        return found

    def _top(self, name: str) -> Column:
        return F.col(f"`{name}`") if self.base is None else self.base[name]

    def leaves(self) -> list[Field]:
        """Every string-bearing leaf, for keyword search."""
        out: list[Field] = []

        def walk(f: Field) -> None:
            if isinstance(f.type, T.StructType):
                for x in f.type.fields:
                    walk(_child(f, x.name))
            elif isinstance(f.type, T.ArrayType) and isinstance(f.type.elementType, T.StructType):
                for x in f.type.elementType.fields:
                    walk(_child(f, x.name))
            elif isinstance(f.type, T.MapType):
                walk(Field(F.map_values(f.column), T.ArrayType(f.type.valueType)))
            elif isinstance(f.type, (T.StringType, T.VariantType)) or isinstance(f.type, T.ArrayType) and isinstance(f.type.elementType, T.StringType):
                out.append(f)

        for x in self.schema.fields:
            walk(Field(self._top(x.name), x.dataType))
        return out


def _once(f: Field, name: str, make) -> Column:
    if name not in f.made:
        f.made[name] = make(f)
    return f.made[name]


def text(f: Field) -> Column:
    """The value as text: whole doubles without a fraction, true/false, null for anything nested."""
    return _once(f, "text", _text)


def lower(f: Field) -> Column:
    return _once(f, "lower", lambda x: F.lower(text(x)))


def _text(f: Field) -> Column:
    t, c = f.type, f.column
    if isinstance(t, T.StringType):
        return c
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    if isinstance(t, T.VariantType):
        return F.try_variant_get(c, "$", "string")
    if isinstance(t, (T.StructType, T.MapType, T.ArrayType, T.NullType)):
        return F.lit(None).cast("string")
    return c.cast("string")


_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def number(f: Field) -> Column:
    """The value as a double; text is parsed only if all of it is a number; booleans aren't numbers."""
    return _once(f, "number", _number_of)


def _number_of(f: Field) -> Column:
    t, c = f.type, f.column
    if isinstance(t, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(t, T.NumericType):
        return c.cast("double")
    s = text(f)
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def epoch(f: Field) -> Column:
    """Whole epoch seconds of a timestamp, an epoch number (milliseconds above 1e12) or ISO text."""
    t, c = f.type, f.column
    if isinstance(t, T.TimestampNTZType):
        return F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000).cast("long")
    if isinstance(t, T.TimestampType):
        return F.floor(F.unix_micros(c) / 1_000_000).cast("long")
    n = number(f)
    return F.coalesce(F.floor(F.when(n > 1e12, n / 1000).otherwise(n)).cast("long"), F.unix_seconds(text(f).try_cast("timestamp")))


def source_fields(df: DataFrame) -> Resolver:
    return Resolver(df.schema)
