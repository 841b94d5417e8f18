from __future__ import annotations

import json

import pytest

from skysift.functions import literals
from skysift.operators.matchers import check
from skysift.plans import conditions, pipelines, rules


def test_precedence_and_flattening():
    assert conditions.parse("a or b and not c or d") == ("or", [("name", "a"), ("and", [("name", "b"), ("not", ("name", "c"))]), ("name", "d")])
    assert conditions.parse("2 of x*") == ("of", 2, "x*")
    assert conditions.parse("any of them") == ("of", 1, "them")


@pytest.mark.parametrize("text", ["", "a and", "(a", "a)", "not", "and a", "a b", "(" * 70 + "a" + ")" * 70])
def test_bad_conditions(text):
    with pytest.raises(conditions.BadCondition):
        conditions.parse(text)


def test_them_skips_underscores():
    assert conditions.selected("them", ["a", "_b"]) == ["a"]
    assert conditions.selected("a*c", ["abc", "ac", "ab"]) == ["abc", "ac"]


def test_wildcards_escape():
    assert literals.wildcard_parts(r"a\*b*?") == ["a*b", None, ...]
    assert literals.wildcard_parts(r"c:\x") == [r"c:\x"]
    assert literals.wildcard_parts("") == [""]


def test_base64_offsets_occur_at_every_alignment():
    import base64

    found = literals.base64_offsets(b"needle")
    for k in range(3):
        assert found[k] in base64.b64encode(b"x" * k + b"needle" + b"yz").decode()


def test_dash_variants():
    assert len(literals.dash_variants("a -b -c")) == 25
    with pytest.raises(ValueError):
        literals.dash_variants("-" * 9)


@pytest.mark.parametrize("mods", [["contains", "endswith"], ["gt", "lt"], ["re", "cidr"], ["i"], ["nope"], ["base64", "base64offset"]])
def test_conflicting_modifiers(mods):
    with pytest.raises(rules.BadRule):
        check(mods)


def test_spans():
    assert [rules.seconds(x) for x in ("5s", "2m", "1h", "1M", "1y")] == [5, 120, 3600, 2629746, 31556952]
    with pytest.raises(rules.BadRule):
        rules.seconds("5 parsecs")


def test_document_actions():
    text = "action: global\nlogsource: {product: web}\n---\ntitle: a\ndetection: {s: {x: 1}, condition: s}\n---\naction: repeat\ntitle: b\n---\naction: reset\n---\ntitle: c\ndetection: {s: {x: 2}, condition: s}\n"
    got = rules.load(text).rules
    assert [(r.title, r.logsource) for r in got] == [("a", {"product": "web"}), ("b", {"product": "web"}), ("c", {})]


def _one(selection, steps, **vars):
    r = rules.load(json.dumps({"title": "r", "detection": {"s": selection, "condition": "s"}}))
    return pipelines.apply(r, [pipelines.load(json.dumps({"transformations": steps, "vars": vars}))]).rules[0]


def test_hashes_become_fields():
    r = _one({"Hashes|contains": ["MD5=" + "a" * 32, "SHA256=" + "b" * 64]}, [{"type": "hashes_fields"}])
    assert sorted(x.items[0].field for x in r.detections["s"].any_of) == ["MD5", "SHA256"]


def test_state_and_nesting():
    steps = [{"type": "set_state", "key": "k", "val": 1}, {"type": "nest", "items": [{"type": "field_name_prefix", "prefix": "p.", "rule_conditions": [{"type": "processing_state", "key": "k", "val": 1}]}]}]
    assert _one({"a": 1}, steps).detections["s"].items[0].field == "p.a"


def test_rule_failure_and_missing_placeholder():
    with pytest.raises(rules.BadRule):
        _one({"a": 1}, [{"type": "rule_failure", "message": "no"}])
    with pytest.raises(rules.BadRule):
        _one({"a|expand": "%none%"}, [{"type": "value_placeholders"}])


def test_finalizers():
    assert pipelines.finalize(["a", "b"], [{"type": "concat", "separator": " OR ", "prefix": "(", "suffix": ")"}]) == "(a OR b)"
