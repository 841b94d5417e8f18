"""Log formats, schema discovery and pattern paths at their edges."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skysift.operators import schemas, stix
from skysift.sources import formats


def parsed(spark, parse, lines, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return {r.i: r for r in parse(df, **options).collect()}


def test_syslog_repeated_parameters_json_and_years(spark):
    lines = [
        '<34>1 2024-01-01T00:00:00Z h a p m [x a="1" a="2" b="q\\"]"][y a="3"] text', '<34>1 - h a - - - {"k": {"z": 1}}', "<34>1 - h a - - - {}", "<13>Dec 31 23:59:58 box app: late", "<13>Feb 29 10:00:00 box app: leap", "<13>Jan  2 10:00:00 box app: new",
        "<999>1 - h a - - - m", "no syslog", None, '<34>1 - h a - - - {"broken": ',
    ]
    got = parsed(spark, formats.syslog, lines, offset="+02:00", now=F.lit("2025-01-02 12:00:00").cast("timestamp"))
    assert got[0].syslog.sd == {"x.a": "2", "x.b": 'q"]', "y.a": "3"} and got[0].syslog.ts == 1704067200
    merged = json.loads(got[1].syslog.event.toJson()) if hasattr(got[1].syslog.event, "toJson") else got[1].syslog.event.toPython()
    assert merged == {"k": {"z": 1}, "syslog_facility": 4, "syslog_severity": 2, "syslog_hostname": "h", "syslog_appname": "a"}
    assert got[2].syslog.event is not None and got[9].syslog.event is None and got[9].syslog.message == '{"broken": '
    assert got[3].syslog.ts == 1735682398  # 2024-12-31 21:59:58 UTC: December read in January
    assert got[4].syslog.ts == 1709193600 and got[5].syslog.ts == 1735804800
    assert [got[i].syslog for i in (6, 7, 8)] == [None, None, None]


def test_logfmt_long_values_and_later_keys(spark):
    long = "v" * 1_000_005
    got = parsed(spark, formats.logfmt, [f"a={long} b", 'a=1 b="x y" a=2 a=3 c= d="" e="q\\"\\\\"', "", None, "=1"])
    assert got[0].logfmt == {"a": long, "b": "true"}
    assert got[1].logfmt == {"a": "3", "b": "x y", "c": "", "d": "", "e": 'q"\\'}
    assert got[2].logfmt is None and got[3].logfmt is None


def test_cef_repeated_extension(spark):
    assert parsed(spark, formats.cef, ["CEF:0|a|b|c|d|e|f|x=1 y=2 x=3"])[0].cef.extensions == {"x": "3", "y": "2"}


def test_otlp_values(spark):
    value = lambda k, v: {"key": k, "value": v}
    record = {
        "timeUnixNano": "0", "observedTimeUnixNano": "1700000000999999999", "severityText": "WARN", "traceId": "t", "body": {"kvlistValue": {"values": [value("m", {"stringValue": "x"})]}},
        "attributes": [value("s", {"stringValue": "a"}), value("i", {"intValue": "5"}), value("b", {"boolValue": True}), value("l", {"arrayValue": {"values": [{"intValue": "1"}]}}), value("y", {"bytesValue": "AAE="}), value("s", {"stringValue": "last"})],
    }
    text = json.dumps({"resourceLogs": [{"resource": {"attributes": [value("host", {"stringValue": "h"})]}, "scopeLogs": [{"scope": {"name": "n"}, "logRecords": [record, {}]}]}]})
    df = spark.createDataFrame([(text,), ("{}",)], "t string").select(F.parse_json("t").alias("event"))
    first = next(r for r in formats.otlp(df).collect() if r.severity)
    assert first.attributes == {"s": "last", "i": "5", "b": "true", "l": '[{"intValue":"1"}]', "y": "AAE="}
    assert first.resource == {"host": "h"} and first.scope == "n" and first.ts == 1700000000 and first.trace_id == "t" and "stringValue" in first.body


def test_leaf_paths_at_any_depth(spark):
    event = {"a": {"b": {"c": {"d": 1}}, "e": [1, 2]}, "l": [{"x": {"y": 1}}, {"z": None}], "n": None, "o": {}, "p": []}
    df = spark.createDataFrame([(json.dumps(event),), ("[1]",), ("nope",), (None,), (json.dumps({"k": 1, "k2": {"k": 2}}),)], "t string")
    got = [r[0] for r in df.select(schemas.leaf_paths(F.col("t"))).collect()]
    assert got == [["a.b.c.d", "a.e", "l.x.y", "l.z", "n", "p"], [], [], [], ["k", "k2.k"]]
    counted = {r.field: r.n for r in schemas.observe(df, "t").collect()}
    assert counted["a.b.c.d"] == 1 and counted["k2.k"] == 1


def test_discovery_places_every_shape(spark, monkeypatch):
    monkeypatch.setattr(schemas, "LEADERS", 3)
    # ten kinds of event, each in many shapes that share four fields; the rarest kind is met last
    data = []
    for kind in range(10):
        for k in range(12 + 10 - kind):
            data.append((json.dumps({**{f"k{kind}_{f}": k for f in range(4)}, "type": f"t{kind}", f"k{kind}_extra{k % 5}": 1}),))
    found = schemas.discover(spark.createDataFrame(data, "t string"), "t")
    assert len(found) == 10
    assert {tuple(s.predicates[0]["in"]["value"]) for s in found} == {(f"t{k}",) for k in range(10)}
    assert schemas.discover(spark.createDataFrame([], "t string"), "t") == []


def test_pattern_paths(spark):
    schema = "obs_id int, ts long, type string, id string, names array<string>, hashes map<string,string>, from_ref string, to_refs array<string>, value string, parts array<struct<body:string>>"
    rows = [
        (1, 10, "email", "e1", ["a", "b"], {"SHA-256": "x.y"}, "m1", ["m2", "m3", "gone"], None, [("hi",), ("yo",)]), (2, 11, "email", "e2", ["b"], {}, None, None, None, []),
        (3, 12, "addr", "m1", None, None, None, None, "me@x", None), (4, 12, "addr", "m2", None, None, None, None, "you@x", None), (5, 12, "addr", "m3", None, None, None, None, "they@x", None),
    ]
    df = spark.createDataFrame(rows, schema)
    ids = lambda p: sorted(r.ids[0] for r in stix.bindings(p, df).collect())
    assert ids("[email:names[0] = 'b']") == [2] and ids("[email:names[*] = 'b']") == [1, 2] and ids("[email:names[5] = 'b']") == []
    assert ids("[email:hashes.'SHA-256' = 'x.y']") == [1] and ids("[email:parts[1].body = 'yo']") == [1] and ids("[email:parts[*].body LIKE 'h%']") == [1]
    assert ids("[email:from_ref.value = 'me@x']") == [1] and ids("[email:to_refs[*].value = 'they@x']") == [1] and ids("[email:to_refs[0].value = 'they@x']") == []
    assert ids("[EXISTS email:from_ref.value]") == [1] and ids("[email:from_ref.value = 'me@x' AND email:to_refs[1].value = 'they@x']") == [1]


def _nodes(df, name: str) -> int:
    """How often an expression stands in the optimised plan, and so may run for each line."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_syslog_lines_are_matched_once(spark):
    df = formats.syslog(spark.createDataFrame([("<34>1 - h a p m [x a=\"1\"] text",)], "value string")).select("syslog.*")
    assert _nodes(df, "regexp_extract(") <= 16
    assert df.first().sd == {"x.a": "1"}


def test_cef_lines_are_matched_once_and_fields_may_be_long(spark):
    long = "\\|v" * 20_000
    df = formats.cef(spark.createDataFrame([(f"CEF:0|{long}|b|c|d|e|f|x=1 y=2",)], "value string")).select("cef.*")
    assert _nodes(df, "regexp_extract(") <= 8
    assert df.first().vendor == "|v" * 20_000 and df.first().extensions == {"x": "1", "y": "2"}
