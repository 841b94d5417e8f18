"""Rule text in and out: lint, SQL emission, dynamic sources, sinks."""

from __future__ import annotations

import json

import pytest

from skysift.operators import detect, outputs
from skysift.plans import emit, lint, pipelines, rules
from skysift.sources import dynamic, formats

ROWS = [(1, "Alpha*", 3.0, None), (2, "beta", 12.0, "x"), (3, None, None, "X"), (4, "it's \\ a beta\nend", 7.5, "beta")]
SCHEMA = "id long, name string, n double, other string"


@pytest.mark.parametrize(
    ("selection", "condition"),
    [
        ({"s": {"name": "ALPHA\\*"}}, "s"), ({"s": {"name|contains": "beta"}}, "s"), ({"s": {"name": "*beta*end"}}, "s"), ({"s": {"name": ["b?ta", "alpha*"]}}, "s"),
        ({"s": {"name|contains": "it's \\ a"}}, "s"), ({"s": {"n|gte": 7.5}}, "s"), ({"s": {"n": 12}}, "s"), ({"s": {"other|exists": False}}, "s"), ({"s": {"other": None}}, "s"),
        ({"s": {"name|neq": "beta"}}, "s"), ({"s": {"name|fieldref": "other"}}, "s"), ({"s": {"name|re": "^b.ta"}}, "s"), ({"a": {"n|gt": 5}, "b": {"other": "x"}}, "a and not b"),
        ({"a": {"n|gt": 5}, "b": {"other": "x"}}, "1 of them"), ({"a": [{"n|gt": 10}, {"other": "x"}]}, "not a"), ({"s": {"name|contains|all": ["be", "ta"]}}, "s"), ({"s": {"name|cased|startswith": "b"}}, "s"),
    ],
)
def test_sql_text_selects_what_columns_do(spark, selection, condition):
    rs = rules.load(json.dumps({"title": "r", "id": "r", "detection": {**selection, "condition": condition}}))
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.createOrReplaceTempView("emitted")
    want = sorted(r.id for r in detect.evaluate(rs, df, keep=["id"]).collect())
    assert sorted(r.id for r in spark.sql(emit.query(rs.rules[0], "emitted")).collect()) == want
    spark.sql(emit.view(rs.rules[0], "emitted"))
    assert spark.table("r").count() == len(want)


def test_sql_text_refuses_what_it_cannot_say():
    for body in ({"s": ["word"]}, {"s": {"ip|cidr": "10.0.0.0/8"}}, {"s": {"xs[all]|gt": 1}}):
        with pytest.raises(rules.BadRule):
            emit.predicate(rules.load(json.dumps({"title": "r", "detection": {**body, "condition": "s"}})).rules[0])


GOOD = {"title": "t", "id": "5f113a8f-8b61-41ca-b90f-d374fa7e4a39", "level": "low", "status": "test", "description": "d", "logsource": {"product": "web"}, "tags": ["attack.t1059"], "detection": {"s": {"a": 1}, "condition": "s"}}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"id": "x"}, "bad_id"), ({"level": "loud"}, "bad_level"), ({"title": None}, "missing_title"), ({"tags": ["Bad Tag"]}, "bad_tag"), ({"tags": "x.y"}, "not_a_list"), ({"extra": 1}, "unknown_key"),
        ({"date": "2024-05-01", "modified": "2023-01-01"}, "modified_before_date"), ({"detection": {"s": {"a": 1}, "condition": "s or q"}}, "unknown_detection"),
        ({"detection": {"s": {"a": 1}, "u": {"a": 2}, "condition": "s"}}, "unused_detection"), ({"detection": {"s": {"a|nope": 1}, "condition": "s"}}, "bad_modifiers"),
        ({"detection": {"s": {"a|re": "("}, "condition": "s"}}, "bad_regex"), ({"detection": {"s": {"a": 1}, "condition": "1 of x*"}}, "empty_selector"), ({"detection": {"s": {"a": 1}, "condition": "(s"}}, "refused"),
        ({"detection": {"s": {"a|contains|all": ["x"]}, "condition": "s"}}, "lonely_all"), ({"logsource": {}}, "missing_logsource"), ({"detection": {"s": {"a": "*"}, "condition": "s"}}, "only_wildcard"),
    ],
)
def test_lint(change, code):
    assert lint.lint(json.dumps(GOOD)) == []
    assert code in {f.code for f in lint.lint(json.dumps({**GOOD, **change}))}


def test_lint_across_documents():
    assert "repeated_id" in {f.code for f in lint.lint(json.dumps(GOOD) + "\n---\n" + json.dumps(GOOD))}
    assert lint.lint("a: [")[0].code == "bad_yaml" and lint.lint("- 1")[0].code == "not_a_map" and lint.lint("") == []


def test_paths():
    data = {"a": {"b": [{"c": 1}, {"c": 2}, {}]}, "k-x": "v"}
    assert dynamic.extract(data, "$.a.b[*].c") == [1, 2] and dynamic.extract(data, "$.a.b[-2].c") == [2]
    assert dynamic.extract(data, "$['k-x']") == ["v"] and dynamic.extract(data, "$.zz") == [] and dynamic.extract(data, "$") == [data]
    with pytest.raises(dynamic.BadSource):
        dynamic.extract(data, "$..")


def test_sources_refresh_and_expand(tmp_path):
    path, now = tmp_path / "s.txt", [0.0]
    path.write_text("# c\nerror\n\nclick\n")
    s = dynamic.Source("kinds", str(path), "lines", refresh="interval", seconds=10, clock=lambda: now[0])
    assert s.get() == ["error", "click"]
    path.write_text("view\n")
    assert s.get() == ["error", "click"]
    now[0] = 11.0
    assert s.get() == ["view"]
    path.unlink()
    now[0] = 30.0
    assert s.get() == ["view"]
    (tmp_path / "m.csv").write_text("k,v\na,1\nb,2\n")
    m = dynamic.Source("m", str(tmp_path / "m.csv"), "csv")
    text = dynamic.expand("vars: {kinds: '${source.kinds}', ks: '${source.m[*].k}', s: 'x-${source.m[1].v}'}", [s, m])
    assert pipelines.load(text).variables == {"kinds": ["view"], "ks": ["a", "b"], "s": "x-2"}
    with pytest.raises(dynamic.BadSource):
        dynamic.expand("vars: {a: '${source.none}'}", [s])
    with pytest.raises(dynamic.BadSource):
        dynamic.Source("z", str(tmp_path / "none")).get()


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, None, 2.5)], "id long, s string, x double")
    assert [json.loads(r.value) for r in outputs.ndjson(df).orderBy("value").collect()] == [{"id": 1, "s": "a,b"}, {"id": 2, "x": 2.5}]
    assert outputs.shown(df, "csv") == 'id,s,x\n1,"a,b",\n2,,2.5'
    assert outputs.shown(df).split("\n")[0] == "id  s    x"
    good, dead = outputs.dead_letters(formats.json(spark.createDataFrame([('{"a":1}',), ("nope",), (" ",), (None,)], "value string")), "event")
    assert good.count() == 1 and [tuple(r) for r in dead.collect()] == [("nope", "no event")]


def test_reports():
    rows = [{"rule_key": "b<", "corpus": None, "fires": 0, "verdict": "fail"}, {"rule_key": "a", "corpus": "c", "fires": 2, "verdict": "pass"}, {"rule_key": "z", "corpus": "c", "fires": 1, "verdict": "warn"}]
    text = outputs.junit(rows)
    assert 'tests="3" failures="1" skipped="1"' in text and 'name="b&lt;"' in text
    layer = outputs.navigator([{"technique": "T1059", "n_rules": 3}], "x")
    assert layer["techniques"] == [{"techniqueID": "T1059", "score": 3, "enabled": True}] and layer["gradient"]["maxValue"] == 3
    assert outputs.administration([{"technique": "T1", "score": 0.5}], "x")["techniques"][0]["visibility"][0]["score_logbook"][0]["score"] == 2
