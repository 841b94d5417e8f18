"""Checks of rule documents before they are compiled: what would fail, and what makes a rule hard to keep."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from typing import Any

import yaml

from skysift.operators.matchers import check
from skysift.plans import conditions, rules
from skysift.plans.rules import LOADER

LEVELS = ("informational", "low", "medium", "high", "critical")
STATUSES = ("stable", "test", "experimental", "deprecated", "unsupported")
KNOWN = {"title", "id", "name", "status", "description", "references", "author", "date", "modified", "tags", "level", "logsource", "detection", "correlation", "filter", "falsepositives", "fields", "related", "license", "scope", "taxonomy", "action", "custom_attributes"}


@dataclass(frozen=True)
class Finding:
    """rule: title of the document, or its number; severity: error, warning or info."""

    rule: str
    code: str
    severity: str
    message: str


def _is_uuid(x: Any) -> bool:
    try:
        return str(uuid.UUID(str(x))) == str(x).lower()
    except ValueError:
        return False


def _walk(d: rules.Detection):
    for i in d.items:
        yield i
        if i.block:
            yield from _walk(i.block)
    for x in [*d.any_of, *d.named.values()]:
        yield from _walk(x)


def _head(doc: dict, say) -> None:
    if not doc.get("title"):
        say("missing_title", "error", "a rule needs a title")
    elif len(str(doc["title"])) > 256:
        say("long_title", "warning", "the title has more than 256 characters")
    if not doc.get("id"):
        say("missing_id", "warning", "a rule should have an id")
    elif not _is_uuid(doc["id"]):
        say("bad_id", "warning", f"id {doc['id']!r} is no UUID")
    for key, allowed in (("level", LEVELS), ("status", STATUSES)):
        if key in doc and str(doc[key]) not in allowed:
            say(f"bad_{key}", "error", f"{key} {doc[key]!r} is none of {', '.join(allowed)}")
        elif key not in doc and "filter" not in doc:
            say(f"missing_{key}", "info", f"no {key}")
    for key in ("date", "modified"):
        if key in doc and not re.fullmatch(r"\d{4}[-/]\d{2}[-/]\d{2}", str(doc[key])):
            say(f"bad_{key}", "warning", f"{key} {doc[key]!r} is no date")
    if doc.get("date") and doc.get("modified") and str(doc["modified"]) < str(doc["date"]):
        say("modified_before_date", "warning", "modified lies before date")
    for key in ("tags", "references", "falsepositives", "fields"):
        if key in doc and not isinstance(doc[key], list):
            say("not_a_list", "error", f"{key} must be a list")
        elif isinstance(doc.get(key), list) and len({str(x) for x in doc[key]}) < len(doc[key]):
            say("repeated_entry", "warning", f"{key} repeats an entry")
    for t in doc.get("tags") or [] if isinstance(doc.get("tags") or [], list) else []:
        if not re.fullmatch(r"[a-z0-9_-]+\.[a-z0-9._-]+", str(t)):
            say("bad_tag", "warning", f"tag {t!r} isn't namespace.name in lower case")
    for key in doc:
        if key not in KNOWN:
            say("unknown_key", "info", f"unknown key {key!r}")
    if not doc.get("description") and "filter" not in doc:
        say("missing_description", "info", "no description")


def _body(doc: dict, say) -> None:
    source = doc.get("logsource")
    if not isinstance(source, dict) or not source:
        say("missing_logsource", "warning", "no log source")
    found, conds = rules._detections(doc)
    used: set[str] = set()
    for c in conds:
        tree = conditions.parse(c)
        for n in conditions.names_in(tree):
            if n not in found:
                say("unknown_detection", "error", f"condition names {n!r}, which isn't defined")
            used.add(n)
        stack = [tree]
        while stack:
            t = stack.pop()
            if t[0] == "of":
                chosen = conditions.selected(t[2], list(found))
                if not chosen:
                    say("empty_selector", "warning", f"{t[2]!r} selects nothing")
                elif t[1] != "all" and t[1] > len(chosen):
                    say("impossible_count", "warning", f"{t[1]} of {t[2]}: only {len(chosen)} there")
                used.update(chosen)
            elif t[0] == "not":
                stack.append(t[1])
            elif t[0] in ("and", "or"):
                stack += t[1]
    for n in found:
        if n not in used:
            say("unused_detection", "warning", f"detection {n!r} isn't used")
    for d in found.values():
        for i in _walk(d):
            try:
                check(i.modifiers)
            except rules.BadRule as e:
                say("bad_modifiers", "error", str(e))
            if "all" in i.modifiers and len(i.values) < 2:
                say("lonely_all", "warning", f"{i.field}: all with one value")
            if not i.block and not i.values:
                say("no_values", "warning", f"{i.field}: an empty list never matches")
            if len({repr(v) for v in i.values}) < len(i.values):
                say("repeated_value", "info", f"{i.field}: a value is repeated")
            for v in i.values:
                if "re" in i.modifiers:
                    try:
                        re.compile(str(v))
                    except re.error as e:
                        say("bad_regex", "error", f"{i.field}: {e}")
                elif isinstance(v, str) and re.fullmatch(r"\*+", v) and not set(i.modifiers) & {"re"}:
                    say("only_wildcard", "info", f"{i.field}: {v!r} asks for presence; exists says so")


def lint(text: str) -> list[Finding]:
    """Findings for each document of a YAML text, in document order; errors are what compiling would refuse."""
    out: list[Finding] = []
    try:
        docs = [d for d in yaml.load_all(text, LOADER) if d is not None]
    except yaml.YAMLError as e:
        return [Finding("", "bad_yaml", "error", str(e).split("\n")[0])]
    seen: dict[str, str] = {}
    for n, doc in enumerate(docs):
        label = str(doc.get("title") or f"document {n}") if isinstance(doc, dict) else f"document {n}"
        say = lambda code, severity, message, label=label: out.append(Finding(label, code, severity, message))
        if not isinstance(doc, dict):
            say("not_a_map", "error", "a document must be a map")
            continue
        if doc.get("action") in ("global", "reset", "repeat"):
            continue
        _head(doc, say)
        if doc.get("id"):
            if str(doc["id"]) in seen:
                say("repeated_id", "error", f"id of {seen[str(doc['id'])]!r}")
            seen.setdefault(str(doc["id"]), label)
        try:
            if "correlation" in doc:
                c = rules._correlation(doc)
                if c.key in c.rules:
                    say("refers_to_itself", "error", "a correlation can't refer to itself")
                if not c.group_by:
                    say("no_group", "info", "without group-by all hits meet in one group")
                for a in c.aliases:
                    if a not in c.group_by:
                        say("unused_alias", "warning", f"alias {a!r} isn't in group-by")
            elif "filter" not in doc:
                _body(doc, say)
        except (rules.BadRule, conditions.BadCondition) as e:
            say("refused", "error", str(e))
    return out
