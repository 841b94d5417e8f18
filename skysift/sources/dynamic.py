"""Small outside data for pipelines: files of JSON, YAML, CSV or lines, read on the driver, refreshed by policy.

A pipeline text may hold `${source.name}` or `${source.name.path}`; a value that is one such reference becomes the data
itself (a list, say), one inside a longer string its text.
"""

from __future__ import annotations

import csv
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

_step = re.compile(r"\.?([A-Za-z_][\w-]*)|\.?\*|\[(\*|-?\d+|'[^']*'|\"[^\"]*\")\]")
_ref = re.compile(r"\$\{source\.([\w-]+)((?:\.[\w-]+|\[[^\]]*\])*)\}")


class BadSource(ValueError):
    """A source that can't be read, or a path or reference that isn't one."""


def extract(data: Any, path: str) -> list[Any]:
    """The values at a JSONPath of names, indexes and stars (`$.a.b[*].c`); what isn't there is left out."""
    rest = path.removeprefix("$")
    found, at = [data], 0
    while at < len(rest):
        m = _step.match(rest, at)
        if not m:
            raise BadSource(f"no path: {path!r}")
        at = m.end()
        key = m[1] if m[1] is not None else "*" if m[2] is None else m[2].strip("'\"")
        out: list[Any] = []
        for x in found:
            if key == "*" and (m[1] is None):
                out += x if isinstance(x, list) else list(x.values()) if isinstance(x, dict) else []
            elif isinstance(x, dict) and key in x:
                out.append(x[key])
            elif isinstance(x, list) and re.fullmatch(r"-?\d+", key) and -len(x) <= int(key) < len(x):
                out.append(x[int(key)])
        found = out
    return found


def parse(text: str, kind: str) -> Any:
    """json, yaml, csv (a list of maps by header) or lines (blank ones and # comments go)."""
    try:
        if kind == "json":
            return json.loads(text)
        if kind == "yaml":
            return yaml.safe_load(text)
    except (ValueError, yaml.YAMLError) as e:
        raise BadSource(f"no {kind}: {e}") from e
    if kind == "csv":
        return list(csv.DictReader(text.splitlines()))
    if kind == "lines":
        return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    raise BadSource(f"unknown format {kind!r}")


@dataclass
class Source:
    """A named file. refresh: once, interval (every `seconds`), watch (when the file changes) or on_demand (reload() alone)."""

    name: str
    path: str
    format: str = "json"
    extract: str | None = None
    refresh: str = "once"
    seconds: float = 300.0
    default: Any = None
    clock: Callable[[], float] = time.monotonic
    _data: Any = None
    _read: float | None = None
    _stamp: float | None = None

    def reload(self) -> Any:
        p = Path(self.path)
        if not p.exists():
            if self.default is None:
                raise BadSource(f"source {self.name!r}: no file {self.path!r}")
            self._data, self._stamp = self.default, None
        else:
            data = parse(p.read_text(encoding="utf-8"), self.format)
            self._data, self._stamp = extract(data, self.extract) if self.extract else data, p.stat().st_mtime
        self._read = self.clock()
        return self._data

    def get(self) -> Any:
        """The data, read anew if the policy asks for it; what was read before stays when a later read fails."""
        old = self._read is None
        if not old and self.refresh == "interval":
            old = self.clock() - self._read >= self.seconds
        elif not old and self.refresh == "watch":
            old = Path(self.path).exists() and Path(self.path).stat().st_mtime != self._stamp
        if not old:
            return self._data
        if self._read is None:
            return self.reload()
        try:
            return self.reload()
        except (BadSource, OSError):
            return self._data


def expand(text: str, sources: list[Source]) -> str:
    """A pipeline's YAML with its source references replaced by their data."""
    by = {s.name: s for s in sources}

    def value(m: re.Match) -> Any:
        if m[1] not in by:
            raise BadSource(f"unknown source {m[1]!r}")
        data = by[m[1]].get()
        if not m[2]:
            return data
        found = extract(data, "$" + m[2])
        return found if "*" in m[2] or len(found) != 1 else found[0]

    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            out: list[Any] = []
            for v in x:
                new = walk(v)
                # a list that stands for one entry takes its place
                out += new if isinstance(v, str) and isinstance(new, list) else [new]
            return out
        if isinstance(x, str):
            whole = _ref.fullmatch(x)
            return value(whole) if whole else _ref.sub(lambda m: str(value(m)), x)
        return x

    return yaml.safe_dump(walk(yaml.safe_load(text) or {}), sort_keys=False, allow_unicode=True)
