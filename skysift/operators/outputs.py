"""Sinks and report formats: JSON lines, dead letters, terminal tables, JUnit, coverage layers."""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Callable, Iterable, Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ndjson(df: DataFrame) -> DataFrame:
    """One JSON object a row (column value), nulls left out: write.text() or a stream's sink takes it."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def dead_letters(lines: DataFrame, parsed: str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """The rows that parsed, and (line, reason) of those that didn't; blank lines are neither."""
    said = lines.where(F.length(F.trim(F.coalesce(F.col(line), F.lit("")))) > 0)
    return said.where(F.col(parsed).isNotNull()), said.where(F.col(parsed).isNull()).select(line, F.lit(f"no {parsed}").alias("reason"))


def deliver(lines: DataFrame, send: Callable[[list[str]], None], tries: int = 3, wait: float = 0.2, batch: int = 500, line: str = "value") -> DataFrame:
    """Send text rows in batches from the executors; rows (value, reason, attempts) of what no try delivered: dead letters.

    send(batch) raises if it fails; it is tried again after wait, 2 wait, ... seconds. Delivery is at least once: a task
    that is run again sends again. Nothing is sent until the result is read or written, so write it, to the dead letters'
    table; in a stream, from foreachBatch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dead = []
            values = pdf[line].tolist()
            for at in range(0, len(values), batch):
                part, reason = values[at : at + batch], None
                for attempt in range(1, tries + 1):
                    try:
                        send(part)
                        reason = None
                        break
                    except Exception as e:
                        reason = f"{type(e).__name__}: {e}"
                        if attempt < tries:
                            time.sleep(wait * 2 ** (attempt - 1))
                if reason:
                    dead += [(v, reason, tries) for v in part]
            yield pd.DataFrame(dead, columns=["value", "reason", "attempts"])

    return lines.select(line).mapInPandas(run, "value string, reason string, attempts int")


def shown(df: DataFrame, kind: str = "table", limit: int = 100) -> str:
    """The first `limit` rows as text for a terminal: table, csv, tsv or json."""
    rows = [[x for x in r] for r in df.limit(limit).collect()]
    text = [["" if x is None else str(x) for x in r] for r in rows]
    if kind == "json":
        return "\n".join(json.dumps(dict(zip(df.columns, r, strict=True)), default=str, ensure_ascii=False) for r in rows)
    if kind in ("csv", "tsv"):
        out = io.StringIO()
        csv.writer(out, delimiter="," if kind == "csv" else "\t", lineterminator="\n").writerows([df.columns, *text])
        return out.getvalue().rstrip("\n")
    if kind != "table":
        raise ValueError(f"unknown output {kind!r}")
    wide = [max(map(len, column)) for column in zip(df.columns, *text, strict=True)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in wide]), *map(line, text)])


def junit(verdicts: Iterable, suite: str = "backtest") -> str:
    """Backtest rows (rule_key, corpus, fires, verdict) as JUnit XML: fail is a failure, warn is skipped."""
    rows = sorted(verdicts, key=lambda r: (r["rule_key"] or "", str(r["corpus"] or "")))
    count = lambda v: sum(r["verdict"] == v for r in rows)
    out = [f"<testsuite name={quoteattr(suite)} tests=\"{len(rows)}\" failures=\"{count('fail')}\" skipped=\"{count('warn')}\">"]
    for r in rows:
        head = f"  <testcase classname={quoteattr(str(r['corpus'] or 'all'))} name={quoteattr(r['rule_key'])}"
        inner = {"fail": f"<failure message={quoteattr(f'{r["fires"]} fires')}/>", "warn": "<skipped/>"}.get(r["verdict"])
        out.append(head + ("/>" if inner is None else f">{inner}</testcase>"))
    return "\n".join([*out, "</testsuite>"])


def navigator(covered: Iterable, name: str, domain: str = "enterprise-attack") -> dict:
    """Coverage rows (technique, n_rules) as a technique layer: score is the number of rules."""
    rows = sorted(((r["technique"], int(r["n_rules"])) for r in covered))
    most = max((n for _, n in rows), default=1)
    return {
        "name": name, "domain": domain, "versions": {"layer": "4.5"}, "gradient": {"colors": ["#ffffff", "#66b1ff"], "minValue": 0, "maxValue": most},
        "techniques": [{"techniqueID": t, "score": n, "enabled": True} for t, n in rows],
    }


def administration(needs: Iterable, name: str, domain: str = "enterprise-attack") -> dict:
    """Visibility rows (technique, seen, needed, score) as a technique administration file; score 0 to 4."""
    rows = sorted((r["technique"], float(r["score"])) for r in needs)
    return {"version": 1.2, "file_type": "technique-administration", "name": name, "domain": domain, "techniques": [{"technique_id": t, "visibility": [{"applicable_to": ["all"], "score_logbook": [{"score": round(4 * s)}]}]} for t, s in rows]}
