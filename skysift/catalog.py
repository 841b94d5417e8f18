"""Registered queries of the engine over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.operators import alerts, correlate, detect, outputs, reports, schemas, stix
from skysift.plans import emit, pipelines, rules
from skysift.sources import formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = {"events": "event_id", "documents": "doc_id", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber", "customer": "c_custkey", "embeddings": "vec_id", "conversations": "conv_id, turn", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rule(selection: dict | list, condition: str = "sel", ident: str = "r", name: str = "sel", **more) -> str:
    """One rule as YAML (JSON is YAML)."""
    body = selection if isinstance(selection, dict) and name == "" else {name: selection}
    return json.dumps({"title": ident, "id": ident, "level": "medium", "detection": {**body, "condition": condition}, **more})


def detects(name: str, source: str, text: str, where: str, prepare: Callable[[DataFrame], DataFrame] | None = None, view: str | None = None) -> None:
    """A one-rule query: keys of the events that fire; its SQL filters the same table."""
    keys = KEYS[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = prepare(df) if prepare else df
        return detect.evaluate(rules.load(text), df, keep=keys.split(", ")).select(*keys.split(", "), "rule_key")

    query(name, f"SELECT {keys}, 'r' AS rule_key FROM {view or source} WHERE {where}")(run)


# --- field matchers -------------------------------------------------------------------------------------------------
detects("det_eq_ci", "events", rule({"event_type": "ERROR"}), "lower(event_type) = 'error'")
detects("det_cased", "events", rule({"event_type|cased": ["error", "Click"]}), "event_type IN ('error', 'Click')")
detects("det_contains", "documents", rule({"text|contains": "THE "}), "contains(lower(text), 'the ')")
detects("det_startswith", "part", rule({"p_name|startswith": "RED"}), "starts_with(lower(p_name), 'red')")
detects("det_endswith", "part", rule({"p_type|endswith": "L"}), "ends_with(lower(p_type), 'l')")
detects("det_wildcard", "part", rule({"p_name": "*e?*t"}), "regexp_matches(lower(p_name), '(?s)^.*e..*t$')")
detects("det_regex", "documents", rule({"text|re": "\\d{3}-\\d{4}"}), "regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
detects("det_regex_flags", "documents", rule({"text|re|i": "THE [a-z]+ing"}), "regexp_matches(text, '(?i)THE [a-z]+ing')")
detects("det_gt", "events", rule({"value|gt": 100}), "value > 100")
detects("det_range", "lineitem", rule({"l_quantity|gte": 10, "l_discount|lt": 0.05}), "l_quantity >= 10 AND l_discount < 0.05")
detects("det_lte", "orders", rule({"o_totalprice|lte": 50000}), "o_totalprice <= 50000")
detects("det_num_eq", "lineitem", rule({"l_linenumber": 3, "l_quantity": 17}), "l_linenumber = 3 AND l_quantity = 17")
detects("det_neq", "events", rule({"event_type|neq": "click"}), "lower(event_type) <> 'click'")
detects("det_neq_all", "events", rule({"event_type|neq|all": ["click", "view"]}), "lower(event_type) NOT IN ('click', 'view')")
_json = lambda df: df.withColumn("p", F.try_parse_json("props"))
detects("det_exists", "events", rule({"p.k|exists": True, "value|gt": 50}), "json_extract(props, '$.k') IS NOT NULL AND value > 50", _json)
detects("det_not_exists", "events", rule({"p.z|exists": False, "value|gt": 50}), "json_extract(props, '$.z') IS NULL AND value > 50", _json)
detects("det_null", "events", rule({"p.z": None, "event_type": "view"}), "json_extract(props, '$.z') IS NULL AND lower(event_type) = 'view'", _json)
detects("det_variant_number", "events", rule({"p.k|gte": 50}), "CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50", _json)
detects("det_bool", "events", rule({"flag": True}), "event_id % 3 = 0", lambda df: df.withColumn("flag", F.when(F.col("event_id") % 3 == 0, "yes").otherwise("no")))
detects("det_fieldref", "customer", rule({"c_custkey|fieldref": "half"}), "c_custkey = c_nationkey * 10", lambda df: df.withColumn("half", F.col("c_nationkey").cast("long") * 10))
detects("det_fieldref_text", "lineitem", rule({"l_returnflag|fieldref": "l_linestatus"}), "lower(l_returnflag) = lower(l_linestatus)")
detects("det_expand", "customer", rule({"c_name|expand|endswith": "%c_custkey%"}), "ends_with(lower(c_name), CAST(c_custkey AS VARCHAR))")
detects("det_hour", "events", rule({"ts|hour": 13}), "date_part('hour', ts) = 13")
detects("det_week", "events", rule({"ts|week": 3}), "date_part('week', ts) = 3")
detects("det_month_year", "orders", rule({"o_orderdate|month": 7}), "date_part('month', o_orderdate) = 7")
_ip = lambda df: df.withColumn("ip", F.concat_ws(".", F.lit("10"), F.lit("0"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string")))
detects("det_cidr", "events", rule({"ip|cidr": ["10.0.16.0/20", "10.0.3.0/24"]}), "user_id % 256 BETWEEN 16 AND 31 OR user_id % 256 = 3", _ip)
_b64 = lambda df: df.withColumn("enc", F.base64(F.encode(F.concat(F.lit("x"), F.col("event_type"), F.lit("-cmd")), "utf-8")))
detects("det_base64", "events", rule({"enc|base64": "xerror-cmd"}), "lower(base64(encode('x' || event_type || '-cmd'))) = lower(base64(encode('xerror-cmd')))", _b64)
detects("det_base64offset", "events", rule({"enc|base64offset|contains": "error-cmd"}), "event_type = 'error'", _b64)
detects("det_windash", "events", rule({"cmd|windash|contains": " -view"}), "event_type = 'view' AND event_id % 3 < 2", lambda df: df.withColumn("cmd", F.concat(F.lit("run "), F.get(F.array(F.lit("-"), F.lit("/"), F.lit("+")), (F.col("event_id") % 3).cast("int")), F.col("event_type"))))
detects("det_all", "documents", rule({"text|contains|all": ["on", "er"]}), "contains(lower(text), 'on') AND contains(lower(text), 'er')")
detects("det_list", "orders", rule({"o_orderpriority": ["1-urgent", "2-HIGH"]}), "lower(o_orderpriority) IN ('1-urgent', '2-high')")
detects("det_many_needles", "documents", rule({"text|contains": ["zulich", "pfung", "ciónos", "mente ", "eaux", "ation", "schaft", "@mail", "password"]}), "regexp_matches(lower(text), 'zulich|pfung|ciónos|mente |eaux|ation|schaft|@mail|password')")
detects("det_keywords", "conversations", rule(["the", "user"]), "contains(lower(text), 'the') OR contains(lower(role), 'the') OR contains(lower(text), 'user') OR contains(lower(role), 'user')")
detects("det_list_of_maps", "events", rule([{"event_type": "error"}, {"value|gt": 150}]), "lower(event_type) = 'error' OR value > 150")

# --- conditions -----------------------------------------------------------------------------------------------------
_three = {"a1": {"event_type": "error"}, "a2": {"value|gt": 50}, "b": {"user_id|lt": 40}}
_n = "(CASE WHEN lower(event_type) = 'error' THEN 1 ELSE 0 END + CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN user_id < 40 THEN 1 ELSE 0 END)"
detects("det_one_of", "events", rule(_three, "1 of a*", name=""), "lower(event_type) = 'error' OR value > 50")
detects("det_n_of", "events", rule(_three, "2 of them", name=""), f"{_n} >= 2")
detects("det_all_of", "events", rule(_three, "all of a* and not b", name=""), "lower(event_type) = 'error' AND value > 50 AND NOT user_id < 40")
detects("det_not_absent", "events", rule({"x": {"missing": "1"}, "y": {"event_type": "signup"}}, "y and not x", name=""), "lower(event_type) = 'signup'")
detects("det_nested", "events", rule(_three, "(a1 or a2) and (b or not a1)", name=""), "(lower(event_type) = 'error' OR value > 50) AND (user_id < 40 OR NOT lower(event_type) = 'error')")

# --- arrays ---------------------------------------------------------------------------------------------------------
detects("det_array_implicit", "embeddings", rule({"embedding|gt": 0.3}), "len(list_filter(embedding, lambda x: x > 0.3)) > 0")
detects("det_array_any", "embeddings", rule({"embedding[any]|gt": 0.35}), "len(list_filter(embedding, lambda x: x > 0.35)) > 0")
detects("det_array_all", "embeddings", rule({"embedding[all]|lt": 0.3}), "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x < 0.3)) = len(embedding)")
detects("det_array_none", "embeddings", rule({"embedding[none]|gt": 0.25}), "len(list_filter(embedding, lambda x: x > 0.25)) = 0")
detects("det_array_index", "embeddings", rule({"embedding[0]|gt": 0.1, "embedding[-1]|lt": 0}), "embedding[1] > 0.1 AND embedding[len(embedding)] < 0")
_members = lambda df: df.withColumn("conn", F.array(F.struct(F.col("user_id").alias("port"), F.col("event_type").alias("kind")), F.struct((F.col("user_id") + 1).alias("port"), F.lit("x").alias("kind"))))
detects("det_array_block", "events", rule({"conn[any]": {"port|lt": 10, "kind": "error"}}), "user_id < 10 AND event_type = 'error'", _members)
detects("det_array_block_condition", "events", rule({"conn[any]": {"p": {"port|gte": 100}, "k": {"kind": "x"}, "condition": "p and not k"}}), "user_id >= 100", _members)
detects("det_array_path", "events", rule({"conn.port": 7}), "user_id = 7 OR user_id + 1 = 7", _members)

_multi = "\n---\n".join([rule({"event_type": "error"}, ident="errors", logsource={"product": "web"}), rule({"value|gt": 120}, ident="large"), rule({"event_type": "purchase", "value|lt": 20}, ident="small")])


@query("det_multi_rule", "SELECT event_id, 'errors' AS rule_key FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'large' FROM events WHERE value > 120 UNION ALL SELECT event_id, 'small' FROM events WHERE event_type = 'purchase' AND value < 20")
def det_multi_rule(spark, sf_dir):
    return detect.evaluate(rules.load(_multi), table(spark, sf_dir, "events"), keep=["event_id"]).select("event_id", "rule_key")


@query("det_filter_rule", "SELECT event_id, 'errors' AS rule_key FROM events WHERE event_type = 'error' AND NOT user_id < 30")
def det_filter_rule(spark, sf_dir):
    text = rule({"event_type": "error"}, ident="errors") + "\n---\n" + json.dumps({"title": "f", "filter": {"rules": ["errors"], "low": {"user_id|lt": 30}, "condition": "not low"}})
    return detect.evaluate(rules.load(text), table(spark, sf_dir, "events"), keep=["event_id"]).select("event_id", "rule_key")


@query("det_logsource", "SELECT event_id, 'errors' AS rule_key FROM events WHERE event_type = 'error' AND user_id % 2 = 0")
def det_logsource(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("product", F.when(F.col("user_id") % 2 == 0, "WEB").otherwise("db"))
    return detect.evaluate(rules.load(_multi), df, route=True, keep=["event_id"]).where("rule_key = 'errors'").select("event_id", "rule_key")


@query("det_selections", "SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'a1' END, CASE WHEN value > 50 THEN 'a2' END) AS names FROM events WHERE event_type = 'error' OR value > 50")
def det_selections(spark, sf_dir):
    out = detect.evaluate(rules.load(rule(_three, "1 of a*", name="")), table(spark, sf_dir, "events"), keep=["event_id"], detail=True)
    return out.select("event_id", F.array_join("matched_selections", ",").alias("names"))


@query("det_explain", "SELECT event_id, event_type = 'error' AS a1, value > 50 AS a2, user_id < 40 AS b, (event_type = 'error' OR value > 50) AS fired FROM events")
def det_explain(spark, sf_dir):
    return detect.explain(rules.load(rule(_three, "1 of a*", name="")).rules[0], table(spark, sf_dir, "events")).select("event_id", "explain.*")


# --- correlations ---------------------------------------------------------------------------------------------------
_errors = rule({"event_type": "error"}, ident="errors")
_buys = rule({"event_type": "purchase"}, ident="buys")
_views = rule({"event_type": "view"}, ident="views")
SPAN = 259200
_hits = "h AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'error')"


def correlation(kind: str, condition: dict | str, refs: list[str], group: list[str] = ("user_id",), span: str = "3d", ident: str = "c", **more) -> str:
    body = {"type": kind, "rules": refs, "group-by": list(group), "timespan": span, "condition": condition, **{k: v for k, v in more.items() if k in ("gap", "window", "aliases")}}
    return json.dumps({"title": ident, "id": ident, "correlation": body, **{k: v for k, v in more.items() if k not in ("gap", "window", "aliases")}})


def fired(text: str, key: str = "c"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = correlate.correlate(rules.load(text), table(spark, sf_dir, "events"), "ts", "event_id")[key]
        groups = [c for c in out.columns if c == "user_id"]
        return out.select(F.col("__seq").alias("event_id"), *(F.col(g).cast("long").alias(g) for g in groups), F.round("value", 6).alias("value"))

    return run


def _window_sql(aggregate: str, having: str, source: str = _hits) -> str:
    """The trailing window by a self-join on arrival: independent of the window plans."""
    return f"WITH {source} SELECT a.event_id, a.user_id, round(CAST({aggregate} AS DOUBLE), 6) AS value FROM h a JOIN h b ON a.user_id = b.user_id AND b.t >= a.t - {SPAN} AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY a.event_id, a.user_id HAVING {having}"


query("corr_event_count", _window_sql("count(*)", "count(*) >= 2"))(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"])))
query("corr_event_count_range", _window_sql("count(*)", "count(*) >= 2 AND count(*) <> 3"))(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 2, "neq": 3}, ["errors"])))
query("corr_value_sum", _window_sql("sum(b.value)", "sum(b.value) > 100"))(fired(_errors + "\n---\n" + correlation("value_sum", {"gt": 100, "field": "value"}, ["errors"])))
query("corr_value_avg", _window_sql("avg(b.value)", "avg(b.value) > 30"))(fired(_errors + "\n---\n" + correlation("value_avg", {"gt": 30, "field": "value"}, ["errors"])))
query("corr_value_median", _window_sql("quantile_cont(b.value, 0.5)", "quantile_cont(b.value, 0.5) > 30"))(fired(_errors + "\n---\n" + correlation("value_median", {"gt": 30, "field": "value"}, ["errors"])))
query("corr_value_percentile", _window_sql("quantile_cont(b.value, 0.9)", "quantile_cont(b.value, 0.9) > 60"))(fired(_errors + "\n---\n" + correlation("value_percentile", {"gt": 60, "field": "value", "percentile": 90}, ["errors"])))
_all = "h AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
_any_rule = rule({"event_id|gte": 0}, ident="any")
query("corr_value_count", _window_sql("count(DISTINCT b.event_type)", "count(DISTINCT b.event_type) >= 3", _all))(fired(_any_rule + "\n---\n" + correlation("value_count", {"gte": 3, "field": "event_type"}, ["any"])))
query("corr_value_count_fields", _window_sql("count(DISTINCT b.event_type || '|' || b.value)", "count(DISTINCT b.event_type || '|' || b.value) >= 4", _all))(fired(_any_rule + "\n---\n" + correlation("value_count", {"gte": 4, "field": ["event_type", "value"]}, ["any"])))
_pair = "h AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type IN ('error', 'purchase'))"
query("corr_temporal", _window_sql("count(DISTINCT b.event_type)", "count(DISTINCT b.event_type) >= 2", _pair))(fired("\n---\n".join([_errors, _buys, correlation("temporal", {"gte": 2}, ["errors", "buys"])])))
query("corr_temporal_expression", _window_sql("count(DISTINCT b.event_type)", "count(*) FILTER (b.event_type = 'purchase') > 0 AND count(*) FILTER (b.event_type = 'error') = 0", _pair))(fired("\n---\n".join([_errors, _buys, correlation("temporal", "buys and not errors", ["errors", "buys"])])))
query(
    "corr_temporal_ordered",
    f"WITH {_pair} SELECT a.event_id, a.user_id, 2.0::DOUBLE AS value FROM h a WHERE EXISTS (SELECT 1 FROM h b JOIN h c ON b.user_id = c.user_id AND b.t <= c.t WHERE b.user_id = a.user_id AND b.event_type = 'error' AND c.event_type = 'purchase' AND b.t >= a.t - {SPAN} AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) AND (c.t < a.t OR c.t = a.t AND c.event_id <= a.event_id))",
)(fired("\n---\n".join([_errors, _buys, correlation("temporal_ordered", {"gte": 2}, ["errors", "buys"])])))
query("corr_no_group", f"WITH {_hits} SELECT a.event_id, round(CAST(count(*) AS DOUBLE), 6) AS value FROM h a JOIN h b ON b.t >= a.t - 3600 AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY a.event_id HAVING count(*) >= 4")(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 4}, ["errors"], [], "1h")))
query("corr_tumbling", f"WITH {_hits}, n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, t - t % {SPAN} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM h) SELECT event_id, user_id, CAST(n AS DOUBLE) AS value FROM n WHERE n >= 2")(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"], window="tumbling")))
_gap = f"WITH {_hits}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, sid ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT event_id, user_id, CAST(n AS DOUBLE) AS value FROM n WHERE n >= 2"
query("corr_session", _gap)(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"], span="90d", gap="1d")))
_order = "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM h)"
query(
    "corr_session_cap",
    f"WITH RECURSIVE {_hits}, {_order}, r AS (SELECT event_id, user_id, t, i, t AS start, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.t, o.i, CASE WHEN o.t - r.t > 86400 OR o.t - r.start > 172800 THEN o.t ELSE r.start END, CASE WHEN o.t - r.t > 86400 OR o.t - r.start > 172800 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT event_id, user_id, CAST(n AS DOUBLE) AS value FROM r WHERE n >= 2",
)(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"], span="2d", gap="1d")))
_fires = f"f AS (SELECT a.event_id, a.user_id, a.t, count(*) AS n FROM h a JOIN h b ON a.user_id = b.user_id AND b.t >= a.t - {SPAN} AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY ALL HAVING count(*) >= 2), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM f)"
query(
    "corr_suppress",
    f"WITH RECURSIVE {_hits}, {_fires}, r AS (SELECT event_id, user_id, i, n, t AS last, true AS fire FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.i, o.n, CASE WHEN o.t >= r.last + 86400 THEN o.t ELSE r.last END, o.t >= r.last + 86400 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT event_id, user_id, CAST(n AS DOUBLE) AS value FROM r WHERE fire",
)(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"], custom_attributes={"suppress": "1d"})))
query(
    "corr_reset",
    f"WITH RECURSIVE {_hits}, {_order}, r AS (SELECT event_id, user_id, i, [t] AS w, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.i, list_append(list_filter(CASE WHEN r.n >= 3 THEN [] ELSE r.w END, lambda x: x >= o.t - {SPAN}), o.t), len(list_filter(CASE WHEN r.n >= 3 THEN [] ELSE r.w END, lambda x: x >= o.t - {SPAN})) + 1 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT event_id, user_id, CAST(n AS DOUBLE) AS value FROM r WHERE n >= 3",
)(fired(_errors + "\n---\n" + correlation("event_count", {"gte": 3}, ["errors"], custom_attributes={"action": "reset"})))
query("corr_chain", f"WITH {_hits}, f AS (SELECT a.event_id, a.user_id, a.t FROM h a JOIN h b ON a.user_id = b.user_id AND b.t >= a.t - {SPAN} AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY ALL HAVING count(*) >= 2) SELECT a.event_id, a.user_id, CAST(count(*) AS DOUBLE) AS value FROM f a JOIN f b ON a.user_id = b.user_id AND b.t >= a.t - 604800 AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY ALL HAVING count(*) >= 2")(
    fired("\n---\n".join([_errors, correlation("event_count", {"gte": 2}, ["errors"]), correlation("event_count", {"gte": 2}, ["c"], span="7d", ident="c2")]), "c2")
)


@query("corr_alias", f"WITH h AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN user_id ELSE user_id + 1 END AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type IN ('error', 'purchase')) SELECT a.event_id, a.k AS who, CAST(count(DISTINCT b.event_type) AS DOUBLE) AS value FROM h a JOIN h b ON a.k = b.k AND b.t >= a.t - {SPAN} AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY ALL HAVING count(DISTINCT b.event_type) >= 2")
def corr_alias(spark, sf_dir):
    text = "\n---\n".join([_errors, _buys, correlation("temporal", {"gte": 2}, ["errors", "buys"], ["who"], aliases={"who": {"errors": "user_id", "buys": "next_id"}})])
    df = table(spark, sf_dir, "events").withColumn("next_id", F.col("user_id") + 1)
    out = correlate.correlate(rules.load(text), df, "ts", "event_id")["c"]
    return out.select(F.col("__seq").alias("event_id"), F.col("who").cast("long").alias("who"), "value")


@query("corr_refs", f"WITH {_hits} SELECT a.event_id, string_agg(CAST(b.event_id AS VARCHAR), ',' ORDER BY b.t, b.event_id) AS refs FROM h a JOIN h b ON a.user_id = b.user_id AND b.t >= a.t - {SPAN} AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY a.event_id HAVING count(*) BETWEEN 2 AND 10")
def corr_refs(spark, sf_dir):
    rs = rules.load(_errors + "\n---\n" + correlation("event_count", {"gte": 2, "lte": 10}, ["errors"]))
    out = correlate.with_events(rs.correlations[0], correlate.hits(rs, table(spark, sf_dir, "events"), "ts", "event_id"), rs, "event_id")
    return out.select(F.col("seq").alias("event_id"), F.array_join(F.transform("event_refs", lambda x: x["id"]), ",").alias("refs"))


@query("corr_generate", "SELECT event_id, 'buys' AS rule_key FROM events WHERE event_type = 'purchase'")
def corr_generate(spark, sf_dir):
    rs = rules.load("\n---\n".join([_errors, _buys, correlation("event_count", {"gte": 2}, ["errors"])]))
    return correlate.detections_kept(rs, detect.evaluate(rs, table(spark, sf_dir, "events"), keep=["event_id"])).select("event_id", "rule_key")


@query("sql_tumbling_having", "SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 5")
def sql_tumbling_having(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = df.groupBy("user_id", F.window("t", "1 day").alias("w")).agg(F.count("*").alias("n")).where("n >= 5")
    return out.select("user_id", F.expr("unix_seconds(w.start) div 86400").alias("day"), "n")


@query("sql_percentile_cont", "SELECT user_id, round(quantile_cont(value, 0.95), 6) AS p FROM events GROUP BY user_id")
def sql_percentile_cont(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.percentile("value", 0.95), 6).alias("p"))


# --- pipelines, schemas, formats ------------------------------------------------------------------------------------
def piped(name: str, selection: dict, steps: list[dict], where: str, variables: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = pipelines.load(json.dumps({"name": name, "vars": variables or {}, "transformations": steps}))
        rs = pipelines.apply(rules.load(rule(selection, logsource={"product": "web"})), [p])
        return detect.evaluate(rs, table(spark, sf_dir, "events"), keep=["event_id"]).select("event_id", "rule_key")

    query(name, f"SELECT event_id, 'r' AS rule_key FROM events WHERE {where}")(run)


piped("pipe_field_mapping", {"Action": "error"}, [{"type": "field_name_mapping", "mapping": {"Action": "event_type"}}], "event_type = 'error'")
piped("pipe_one_to_many", {"Num|lt": 5}, [{"type": "field_name_mapping", "mapping": {"Num": ["user_id", "value"]}}], "user_id < 5 OR value < 5")
piped("pipe_add_condition", {"event_type": "error"}, [{"type": "add_condition", "conditions": {"user_id|lt": 20}, "rule_conditions": [{"type": "logsource", "product": "web"}]}], "event_type = 'error' AND user_id < 20")
piped("pipe_placeholders", {"event_type|expand": "%kinds%"}, [{"type": "value_placeholders"}], "event_type IN ('error', 'signup')", {"kinds": ["error", "signup"]})
piped("pipe_map_string", {"event_type": "failure"}, [{"type": "map_string", "mapping": {"failure": ["error", "signup"]}}], "event_type IN ('error', 'signup')")
piped("pipe_replace_string", {"event_type": "err-or"}, [{"type": "replace_string", "regex": "-", "replacement": ""}], "event_type = 'error'")
piped("pipe_drop_item", {"event_type": "error", "noise": "x"}, [{"type": "drop_detection_item", "field_name_conditions": [{"type": "include_fields", "fields": ["noise"]}]}], "event_type = 'error'")

SIGNATURES = [
    schemas.Signature("orders_like", [{"equals": {"field": "event_type", "value": "purchase"}}, {"present": "value"}, {"compare": {"field": "value", "op": "gt", "value": 20}}], mapping={"amount": "value"}),
    schemas.Signature("error_like", [{"matches": {"field": "event_type", "value": "^err"}}], 2, {"amount": "user_id"}),
    schemas.Signature("web_like", [{"in": {"field": "event_type", "value": ["click", "view", "purchase"]}}], mapping={"amount": "event_id"}),
    schemas.Signature("generic", [{"not": {"absent": "event_id"}}], 0, {}),
]
_case = "CASE WHEN event_type = 'purchase' AND value > 20 THEN 'orders_like' WHEN starts_with(event_type, 'err') THEN 'error_like' {} END"


@query("schema_classify", "SELECT event_id, " + _case.format("ELSE CASE WHEN 'generic' < 'web_like' THEN 'generic' END") + " AS schema FROM events")
def schema_classify(spark, sf_dir):
    return schemas.classify(table(spark, sf_dir, "events"), SIGNATURES).select("event_id", "schema")


@query("schema_counts", "SELECT " + _case.format("ELSE 'generic'") + " AS schema, count(*) AS n FROM events GROUP BY 1")
def schema_counts(spark, sf_dir):
    return schemas.classify(table(spark, sf_dir, "events"), SIGNATURES).groupBy("schema").agg(F.count("*").alias("n"))


@query("schema_route", "SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) ELSE NULL END AS amount FROM events WHERE NOT (event_type = 'purchase' AND value > 20)")
def schema_route(spark, sf_dir):
    return schemas.route(table(spark, sf_dir, "events"), SIGNATURES).where("schema <> 'orders_like'").select("event_id", "amount")


@query("fields_observed", "SELECT 'k' AS field, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def fields_observed(spark, sf_dir):
    return schemas.observe(table(spark, sf_dir, "events"), "props")


@query("fields_missing", "SELECT * FROM (VALUES ('k', 'used'), ('z', 'missing')) AS t(field, state)")
def fields_missing(spark, sf_dir):
    return schemas.coverage(schemas.observe(table(spark, sf_dir, "events"), "props"), ["k", "z"])


def lines(df: DataFrame, text) -> DataFrame:
    return df.withColumn("value", text).drop("ts")


@query("parse_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json(spark, sf_dir):
    return formats.json(table(spark, sf_dir, "events"), "props").select("event_id", F.try_variant_get("event", "$.k", "long").alias("k"))


@query("parse_syslog", "SELECT event_id, 4 AS facility, 2 AS severity, 'h' || user_id AS hostname, event_type AS appname, CAST(event_id AS VARCHAR) AS procid, event_type AS kind, 'a]b' AS q, 'msg ' || user_id AS message FROM events")
def parse_syslog(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    line = F.concat(F.lit("<34>1 2024-01-01T00:00:00Z h"), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit(" "), F.col("event_id"), F.lit(' - [x@1 kind="'), F.col("event_type"), F.lit('" q="a\\]b"] msg '), F.col("user_id"))
    s = formats.syslog(lines(df, line)).select("event_id", "syslog.*")
    return s.select("event_id", "facility", "severity", "hostname", "appname", "procid", F.col("sd")["x@1.kind"].alias("kind"), F.col("sd")["x@1.q"].alias("q"), "message")


@query("parse_syslog_old", "SELECT event_id, 16 AS facility, 6 AS severity, 'h' || user_id AS hostname, 'app' AS appname, CAST(event_id AS VARCHAR) AS procid, 'did ' || event_type AS message FROM events")
def parse_syslog_old(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    line = F.concat(F.lit("<134>Jan  5 10:00:00 h"), F.col("user_id"), F.lit(" app["), F.col("event_id"), F.lit("]: did "), F.col("event_type"))
    return formats.syslog(lines(df, line)).select("event_id", "syslog.facility", "syslog.severity", "syslog.hostname", "syslog.appname", "syslog.procid", "syslog.message")


@query("parse_logfmt", "SELECT event_id, event_type AS type, 'a \"b\" ' || user_id AS msg, 'true' AS flag, '' AS empty FROM events")
def parse_logfmt(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    line = F.concat(F.lit("type="), F.col("event_type"), F.lit(' msg="a \\"b\\" '), F.col("user_id"), F.lit('" flag empty='))
    m = formats.logfmt(lines(df, line))
    return m.select("event_id", *(F.col("logfmt")[k].alias(k) for k in ("type", "msg", "flag", "empty")))


@query("parse_cef", "SELECT event_id, 'Acme|Co' AS vendor, event_type AS signature, '10.0.0.' || user_id AS src, 'two words a=b' AS msg FROM events")
def parse_cef(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    line = F.concat(F.lit("<13>x CEF:0|Acme\\|Co|p|1.0|"), F.col("event_type"), F.lit("|n|5|src=10.0.0."), F.col("user_id"), F.lit(" msg=two words a\\=b dpt=80"))
    c = formats.cef(lines(df, line))
    return c.select("event_id", "cef.vendor", "cef.signature", F.col("cef.extensions")["src"].alias("src"), F.col("cef.extensions")["msg"].alias("msg"))


@query("parse_auto", "SELECT CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'cef' WHEN 3 THEN 'logfmt' ELSE 'plain' END AS format, count(*) AS n FROM events GROUP BY 1")
def parse_auto(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    kinds = F.array(F.col("props"), F.lit("<34>1 - h a - - - m"), F.lit("CEF:0|a|b|c|d|e|f|g=h"), F.lit("a=1 b=2"), F.lit("just words"))
    return formats.auto(lines(df, F.get(kinds, (F.col("event_id") % 5).cast("int")))).groupBy("format").agg(F.count("*").alias("n"))


# --- after detection ------------------------------------------------------------------------------------------------
def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    return df.select(F.col("event_id").alias("seq"), "user_id", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts"), F.col("event_type").alias("rule_title"), F.concat(F.lit("id-"), F.col("event_type")).alias("rule_id"), level.alias("level"), F.when(F.col("event_type") == "error", F.array(F.lit("attack.t1059"), F.lit("attack.execution"))).otherwise(F.array().cast("array<string>")).alias("tags"))


_a = "a AS (SELECT event_id AS seq, user_id, value, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"


@query("alert_scope", f"WITH {_a} SELECT seq FROM a WHERE event_type = 'error' AND (event_type LIKE 'err%' OR event_type LIKE 'pur%')")
def alert_scope(spark, sf_dir):
    return alerts.scope(_alerts(spark, sf_dir), ["err*", "pur*"], ["attack.*"], ["high", "medium"]).select("seq")


@query("enrich_lookup", f"WITH {_a} SELECT seq, coalesce(c_mktsegment, 'none') AS segment FROM a LEFT JOIN customer ON user_id = c_custkey")
def enrich_lookup(spark, sf_dir):
    return alerts.enrich(_alerts(spark, sf_dir), table(spark, sf_dir, "customer"), {"user_id": "c_custkey"}, {"c_mktsegment": "segment"}, {"segment": "none"}).select("seq", "segment")


@query("enrich_template", f"WITH {_a} SELECT seq, 'user ' || user_id || ' did ' || event_type AS note FROM a")
def enrich_template(spark, sf_dir):
    return _alerts(spark, sf_dir).select("seq", alerts.render("user ${user_id} did ${rule_title}").alias("note"))


def _scored(spark, sf_dir):
    return _alerts(spark, sf_dir).withColumn("score", alerts.risk_score({"attack.t1059": 40, "attack.*": 25}, {"medium": 10}, 1.0))


@query("risk_score", f"WITH {_a} SELECT seq, CAST(CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 10 ELSE 1 END AS DOUBLE) AS score FROM a")
def risk_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", "score")


_risk = f"{_a}, s AS (SELECT *, CAST(CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 10 ELSE 1 END AS DOUBLE) AS score FROM a), w AS (SELECT x.seq, x.user_id, x.ts, sum(y.score) AS window_score FROM s x JOIN s y ON x.user_id = y.user_id AND y.ts > x.ts - 86400 AND (y.ts < x.ts OR y.ts = x.ts AND y.seq <= x.seq) GROUP BY ALL HAVING sum(y.score) >= 50)"


@query("risk_incidents", f"WITH {_risk} SELECT seq, CAST(user_id AS VARCHAR) AS object_value, window_score FROM w")
def risk_incidents(spark, sf_dir):
    objects = alerts.risk_objects(_scored(spark, sf_dir).withColumn("tactics", F.col("tags")), {"user_id": "user"})
    return alerts.risk_incidents(objects, 86400, 50.0).select("seq", "object_value", "window_score")


@query("risk_cooldown", f"WITH RECURSIVE {_risk}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS i FROM w), r AS (SELECT seq, user_id, i, ts AS last, true AS fire FROM o WHERE i = 1 UNION ALL SELECT o.seq, o.user_id, o.i, CASE WHEN o.ts >= r.last + 43200 THEN o.ts ELSE r.last END, o.ts >= r.last + 43200 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT seq, CAST(user_id AS VARCHAR) AS object_value FROM r WHERE fire")
def risk_cooldown(spark, sf_dir):
    objects = alerts.risk_objects(_scored(spark, sf_dir).withColumn("tactics", F.col("tags")), {"user_id": "user"})
    return alerts.risk_incidents(objects, 86400, 50.0, cooldown=43200).select("seq", "object_value")


_runs = f"WITH {_a}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, seq) >= 172800 THEN 1 ELSE 0 END AS new FROM a), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM g)"


@query("dedup", f"{_runs} SELECT user_id, event_type AS rule_title, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, event_type, run")
def dedup(spark, sf_dir):
    return alerts.dedup(_alerts(spark, sf_dir), ["user_id", "rule_title"], 172800)


@query("silence", f"WITH {_a} SELECT seq FROM a WHERE NOT (event_type = 'click' AND ts >= 1704500000 AND ts < 1705500000) AND NOT (event_type LIKE 'v%' AND CAST(user_id AS VARCHAR) LIKE '1%')")
def silence(spark, sf_dir):
    return alerts.silence(_alerts(spark, sf_dir), [{"match": {"rule_title": "click"}, "start": 1704500000, "end": 1705500000}, {"match": {"rule_title": "v*", "user_id": "1*"}}]).select("seq")


@query("inhibit", f"WITH {_a} SELECT seq FROM a x WHERE NOT (event_type = 'click' AND EXISTS (SELECT 1 FROM a y WHERE y.event_type = 'error' AND y.user_id = x.user_id AND y.ts >= x.ts - 7200 AND (y.ts < x.ts OR y.ts = x.ts AND y.seq < x.seq)))")
def inhibit(spark, sf_dir):
    return alerts.inhibit(_alerts(spark, sf_dir), F.col("rule_title") == "error", F.col("rule_title") == "click", ["user_id"], 7200).select("seq")


@query("incident_group", f"WITH {_a}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) >= 43200 THEN 1 ELSE 0 END AS new FROM a), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS first_seen, count(*) AS n_alerts, count(DISTINCT event_type) AS n_rules, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_level FROM s GROUP BY user_id, run")
def incident_group(spark, sf_dir):
    return alerts.incidents(_alerts(spark, sf_dir), ["user_id"], 43200).select("user_id", "first_seen", "n_alerts", "n_rules", "max_level")


@query("ocsf", f"WITH {_a} SELECT seq, 2004 AS class_uid, ts * 1000 AS time, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS severity_id, event_type AS title FROM a")
def ocsf(spark, sf_dir):
    df = _alerts(spark, sf_dir)
    return alerts.ocsf(df.withColumn("rule_id", F.col("seq").cast("string"))).select(F.col("finding_info.uid").cast("long").alias("seq"), "class_uid", "time", "severity_id", F.col("finding_info.title").alias("title"))


@query("disposition_fp_ratio", "WITH v AS (SELECT DISTINCT source, doc_id, toxic FROM labels JOIN documents USING (doc_id)) SELECT source AS rule_id, count(*) AS total, count(*) FILTER (toxic = 0) AS fp, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (toxic = 0) / count(*), 6) END AS fp_ratio FROM v GROUP BY source")
def disposition_fp_ratio(spark, sf_dir):
    v = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    r = v.select(F.col("source").alias("rule_id"), F.col("doc_id").alias("dedup_key"), F.when(F.col("toxic") == 0, "false_positive").otherwise("true_positive").alias("verdict"), F.lit(100).alias("ts"))
    return alerts.dispositions(r, 100, 100).select("rule_id", "total", "fp", F.round("fp_ratio", 6).alias("fp_ratio"))


# --- reports --------------------------------------------------------------------------------------------------------
@query("backtest_counts", "SELECT corpus, rule_key, count(*) AS fires FROM (SELECT user_id % 4 AS corpus, 'errors' AS rule_key FROM events WHERE event_type = 'error' UNION ALL SELECT user_id % 4, 'large' FROM events WHERE value > 120 UNION ALL SELECT user_id % 4, 'small' FROM events WHERE event_type = 'purchase' AND value < 20) GROUP BY ALL")
def backtest_counts(spark, sf_dir):
    return reports.fire_counts(rules.load(_multi), table(spark, sf_dir, "events").withColumn("corpus", F.col("user_id") % 4), "corpus")


@query("backtest_verdicts", "WITH n AS (SELECT count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (value > 120) AS l, count(*) FILTER (event_type = 'purchase' AND value < 20) AS s FROM events) SELECT 'errors' AS rule_key, e AS fires, CASE WHEN e >= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM n UNION ALL SELECT 'large', l, CASE WHEN l = 0 THEN 'pass' ELSE 'fail' END FROM n UNION ALL SELECT 'small', s, 'warn' FROM n")
def backtest_verdicts(spark, sf_dir):
    counts = reports.fire_counts(rules.load(_multi), table(spark, sf_dir, "events").withColumn("corpus", F.lit("all")), "corpus")
    expected = spark.createDataFrame([("errors", "all", 1, None, None), ("large", "all", None, None, 0)], "rule_key string, corpus string, at_least int, at_most int, exactly int")
    return reports.backtest(counts, expected).select("rule_key", "fires", "verdict")


_tagged = "\n---\n".join([rule({"event_type": "error"}, ident="errors", tags=["attack.t1059.001", "attack.execution"]), rule({"value|gt": 1000000}, ident="never", tags=["attack.t1003"]), rule({"event_type": "view"}, ident="views")])


@query("coverage_gaps", "SELECT 'T1110' AS technique")
def coverage_gaps(spark, sf_dir):
    targets = spark.createDataFrame([("T1059.001",), ("T1110",), ("T1003.002",)], "technique string")
    return reports.gaps(reports.coverage(reports.rule_table(spark, rules.load(_tagged))), targets)


@query("scorecard_verdict", "WITH n AS (SELECT count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'view') AS v FROM events) SELECT 'errors' AS rule_key, e AS fires, CASE WHEN e > 1000 THEN 'tune' ELSE 'keep' END AS verdict FROM n UNION ALL SELECT 'never', 0, 'keep' UNION ALL SELECT 'views', v, CASE WHEN v > 1000 THEN 'retire' ELSE 'tune' END FROM n")
def scorecard_verdict(spark, sf_dir):
    rs = rules.load(_tagged)
    t = reports.rule_table(spark, rs)
    counts = reports.fire_counts(rs, table(spark, sf_dir, "events").withColumn("corpus", F.lit("all")), "corpus")
    ratios = spark.createDataFrame([("views", 0.9)], "rule_id string, fp_ratio double")
    return reports.scorecard(t, counts, ratios, reports.coverage(t)).select("rule_key", "fires", "verdict")


@query("hygiene", "SELECT * FROM (VALUES ('errors', false, false), ('never', true, false), ('views', false, true)) AS t(rule_key, silent, untagged)")
def hygiene(spark, sf_dir):
    rs = rules.load(_tagged)
    counts = reports.fire_counts(rs, table(spark, sf_dir, "events").withColumn("corpus", F.lit("all")), "corpus")
    return reports.hygiene(reports.rule_table(spark, rs), counts).select("rule_key", "silent", "untagged")


# --- threat patterns and graphs -------------------------------------------------------------------------------------
def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("obs_id"), F.col("user_id"), F.lit("action").alias("type"), F.col("event_type").alias("name"), "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts"))


_o = "o AS (SELECT event_id AS id, user_id, event_type AS name, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"


@query("stix_observation", f"WITH {_o} SELECT id FROM o WHERE name IN ('error', 'signup') AND value > 20 OR name LIKE 'pur%' AND NOT value < 100")
def stix_observation(spark, sf_dir):
    p = "[action:name IN ('error', 'signup') AND action:value > 20 OR action:name LIKE 'pur%' AND action:value NOT < 100]"
    return stix.bindings(p, _observed(spark, sf_dir)).select(F.get("ids", F.lit(0)).alias("id"))


@query("stix_followedby", f"WITH {_o} SELECT DISTINCT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM o a JOIN o b ON a.user_id = b.user_id AND a.id <> b.id AND a.t <= b.t WHERE a.name = 'error' AND b.name = 'purchase' AND b.t - a.t <= 86400")
def stix_followedby(spark, sf_dir):
    p = "([action:name = 'error'] FOLLOWEDBY [action:name = 'purchase']) WITHIN 1 DAYS"
    return stix.bindings(p, _observed(spark, sf_dir), ["user_id"]).select(F.get("ids", F.lit(0)).alias("x"), F.get("ids", F.lit(1)).alias("y"))


@query("stix_repeats", f"WITH {_o}, r AS (SELECT user_id, t, lag(t, 2) OVER (PARTITION BY user_id ORDER BY t, id) AS f FROM o WHERE name = 'error') SELECT user_id, f AS first, t AS last FROM r WHERE t - f <= 604800")
def stix_repeats(spark, sf_dir):
    return stix.bindings("[action:name = 'error'] REPEATS 3 TIMES WITHIN 7 DAYS", _observed(spark, sf_dir), ["user_id"]).select("user_id", "first", "last")


@query("graph_expand", "WITH n AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS up FROM nation), s AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS up FROM supplier), e AS (SELECT * FROM n UNION ALL SELECT * FROM s) SELECT 'r0' AS node, 0 AS depth UNION ALL SELECT id, 1 FROM n WHERE up = 'r0' UNION ALL SELECT s.id, 2 FROM s JOIN n ON s.up = n.id WHERE n.up = 'r0'")
def graph_expand(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("in").alias("kind"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("in").alias("kind"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return stix.expand(n.union(s), spark.createDataFrame([("r0",)], "node string"), 2, ["in"])


# --- more matchers, conditions, transformations and formats ------------------------------------------------------------
_utf16 = lambda encoding: lambda df: df.withColumn("enc", F.base64(F.encode(F.concat(F.col("event_type"), F.lit("-x")), encoding)))
detects("det_wide", "events", rule({"enc|wide|base64": "error-x"}), "event_type = 'error'", _utf16("UTF-16LE"))
detects("det_utf16be", "events", rule({"enc|utf16be|base64": "click-x"}), "event_type = 'click'", _utf16("UTF-16BE"))
detects("det_wide_offset", "events", rule({"enc|wide|base64offset|contains": "rror"}), "event_type = 'error'", _utf16("UTF-16LE"))
detects("det_minute", "events", rule({"ts|minute": 30}), "date_part('minute', ts) = 30")
detects("det_day", "events", rule({"ts|day": 5}), "date_part('day', ts) = 5")
detects("det_year", "orders", rule({"o_orderdate|year": 1995}), "date_part('year', o_orderdate) = 1995")
detects("det_condition_list", "events", rule(_three, ["a1 and a2", "b and not a1"], name=""), "lower(event_type) = 'error' AND value > 50 OR user_id < 40 AND NOT lower(event_type) = 'error'")
detects("det_mixed_lists", "events", rule([{"event_type": ["error", "signup"], "value|gt": 20}, {"user_id": [1, 2, 3], "event_type|contains|all": ["c", "k"]}]), "lower(event_type) IN ('error', 'signup') AND value > 20 OR user_id IN (1, 2, 3) AND contains(event_type, 'c') AND contains(event_type, 'k')")
detects("det_cidr6", "events", rule({"ip|cidr": "2001:db8::/120"}), "user_id % 300 < 256", lambda df: df.withColumn("ip", F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("user_id") % 300)))))
piped("pipe_prefix", {"type": "error"}, [{"type": "field_name_prefix", "prefix": "event_"}], "event_type = 'error'")
piped("pipe_suffix", {"event": "error"}, [{"type": "field_name_suffix", "suffix": "_type"}], "event_type = 'error'")
piped("pipe_prefix_mapping", {"evt.type": "error"}, [{"type": "field_name_prefix_mapping", "mapping": {"evt.": "event_"}}], "event_type = 'error'")
piped("pipe_name_function", {"EventType": "error"}, [{"type": "field_name_transform", "transform_func": "snake_case"}], "event_type = 'error'")
piped("pipe_set_value", {"user_id|lt": 1}, [{"type": "set_value", "value": 25}], "user_id < 25")
piped("pipe_convert", {"user_id": "7"}, [{"type": "convert_type", "target_type": "num"}], "user_id = 7")
piped("pipe_case", {"event_type|cased": "ERROR"}, [{"type": "case", "method": "lower"}], "event_type = 'error'")
piped("pipe_nested_steps", {"Kind": "error", "user|lt": 50}, [{"type": "nest", "items": [{"type": "field_name_mapping", "mapping": {"Kind": "event_type"}}, {"type": "field_name_suffix", "suffix": "_id", "field_name_conditions": [{"type": "include_fields", "fields": ["user"]}]}]}], "event_type = 'error' AND user_id < 50")
piped("pipe_logsource", {"event_type": "error"}, [{"type": "change_logsource", "category": "net"}, {"type": "add_condition", "conditions": {"user_id|lt": 30}, "rule_conditions": [{"type": "logsource", "category": "net"}]}], "event_type = 'error' AND user_id < 30")
piped("pipe_wildcards", {"event_type|expand": "%any%rror"}, [{"type": "wildcard_placeholders"}], "event_type LIKE '%rror'")
piped("pipe_negated_condition", {"event_type": "error"}, [{"type": "add_condition", "conditions": {"user_id|lt": 30}, "negated": True}], "event_type = 'error' AND NOT user_id < 30")
piped("pipe_regex_step", {"event_type": "error"}, [{"type": "regex"}, {"type": "set_state", "key": "k", "val": 1}, {"type": "set_custom_attribute", "attribute": "a", "value": "b"}], "event_type = 'error'")


@query("parse_syslog_merged", "SELECT event_id, 'h' || user_id AS hostname, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'only' END AS q, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS BIGINT) END AS u, CASE WHEN event_id % 3 = 0 THEN 'h' || user_id END AS merged FROM events")
def parse_syslog_merged(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    repeated = F.when(F.col("event_id") % 2 == 0, ' q="first" q="second"').otherwise(' q="only"')
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"u": '), F.col("user_id"), F.lit("}"))).otherwise("plain")
    line = F.concat(F.lit("<34>1 - h"), F.col("user_id"), F.lit(' a - - [s kind="'), F.col("event_type"), F.lit('"'), repeated, F.lit("] "), body)
    s = formats.syslog(lines(df, line)).select("event_id", "syslog.*")
    return s.select("event_id", "hostname", F.col("sd")["s.kind"].alias("kind"), F.col("sd")["s.q"].alias("q"), F.try_variant_get("event", "$.u", "long").alias("u"), F.try_variant_get("event", "$.syslog_hostname", "string").alias("merged"))


@query("parse_otlp", "SELECT event_id, 'svc' || user_id AS service, event_type AS severity, CAST(event_id AS VARCHAR) AS body, '[{\"intValue\":\"1\"}]' AS listed, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CAST(1700000000 + event_id AS BIGINT) AS ts FROM events")
def parse_otlp(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    record = F.concat(F.lit('{"timeUnixNano": "'), (F.col("event_id") + 1700000000).cast("string"), F.lit('000000007", "severityText": "'), F.col("event_type"), F.lit('", "body": {"intValue": "'), F.col("event_id"), F.lit('"}, "attributes": [{"key": "l", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}, {"key": "f", "value": {"boolValue": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}}]}"))
    text = F.concat(F.lit('{"resourceLogs": [{"resource": {"attributes": [{"key": "service", "value": {"stringValue": "svc'), F.col("user_id"), F.lit('"}}]}, "scopeLogs": [{"scope": {"name": "n"}, "logRecords": ['), record, F.lit("]}]}]}"))
    rows = formats.otlp(df.select(F.parse_json(text).alias("event")))
    return rows.select(F.col("body").cast("long").alias("event_id"), F.col("resource")["service"].alias("service"), "severity", "body", F.col("attributes")["l"].alias("listed"), F.col("attributes")["f"].alias("flag"), "ts")


@query("parse_envelope", "SELECT event_id, CAST(unnest([user_id, event_id]) AS BIGINT) AS n FROM events")
def parse_envelope(spark, sf_dir):
    text = F.concat(F.lit('{"records": [{"n": '), F.col("user_id"), F.lit('}, {"n": '), F.col("event_id"), F.lit("}]}"))
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("event"))
    return formats.envelope(df, "event", "$.records").select("event_id", F.try_variant_get("event", "$.n", "long").alias("n"))


@query("fields_observed_deep", "SELECT unnest(CASE WHEN event_id % 2 = 0 THEN ['a.b.c', 'l.x', 'k'] ELSE ['a.b.c', 'k'] END) AS field, count(*) AS n FROM events GROUP BY 1")
def fields_observed_deep(spark, sf_dir):
    text = F.concat(F.lit('{"a": {"b": {"c": 1}}, "k": null'), F.when(F.col("event_id") % 2 == 0, ', "l": [{"x": 1}, {"x": 2}]').otherwise(""), F.lit("}"))
    return schemas.observe(table(spark, sf_dir, "events").select(text.alias("e")), "e")


@query("entity_graph", "WITH RECURSIVE c AS (SELECT DISTINCT o_custkey AS k FROM orders), e AS (SELECT x.k AS a, y.k AS b FROM c x JOIN c y ON x.k // 2 = y.k // 2 OR (x.k % 16 <> 15 AND y.k % 16 <> 15 AND (x.k + 1) // 2 = (y.k + 1) // 2)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a, min(o_orderkey) AS incident FROM r JOIN orders ON b = o_custkey GROUP BY a) SELECT o_orderkey, incident FROM orders JOIN m ON a = o_custkey")
def entity_graph(spark, sf_dir):
    half = lambda c: F.floor(c / 2).cast("string")
    key = F.col("o_custkey")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("x"), half(key)).alias("low"), F.when(key % 16 != 15, F.concat(F.lit("y"), half(key + 1))).alias("high"))
    return alerts.entity_incidents(df, "o_orderkey", ["low", "high"])


@query("stix_paths", "SELECT event_id AS id FROM events WHERE user_id > 30 AND event_type = 'error' OR user_id = 5")
def stix_paths(spark, sf_dir):
    df = _observed(spark, sf_dir).withColumn("pair", F.array("name", F.col("user_id").cast("string"))).withColumn("meta", F.create_map(F.lit("a.b"), "user_id"))
    p = "[action:pair[0] = 'error' AND action:meta.'a.b' > 30 OR action:pair[*] = '5']"
    return stix.bindings(p, df).select(F.get("ids", F.lit(0)).alias("id"))


@query("stix_references", "SELECT event_id AS id FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING' AND event_type = 'purchase'")
def stix_references(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    df = _observed(spark, sf_dir).withColumn("actor_ref", F.concat(F.lit("u"), "user_id"))
    return stix.bindings("[action:actor_ref.segment = 'BUILDING' AND action:name = 'purchase']", df, objects=people).select(F.get("ids", F.lit(0)).alias("id"))


@query("stix_start_stop", f"WITH {_o} SELECT id FROM o WHERE name = 'error' AND t >= epoch(TIMESTAMP '2024-01-05') AND t < epoch(TIMESTAMP '2024-01-20')")
def stix_start_stop(spark, sf_dir):
    p = "[action:name = 'error'] START t'2024-01-05T00:00:00Z' STOP t'2024-01-20T00:00:00Z'"
    return stix.bindings(p, _observed(spark, sf_dir)).select(F.get("ids", F.lit(0)).alias("id"))


@query("stix_and_or", f"WITH {_o} SELECT DISTINCT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM o a JOIN o b ON a.user_id = b.user_id AND a.id <> b.id WHERE a.name = 'error' AND a.value > 60 AND b.name = 'signup' AND b.value > 60 UNION SELECT id, NULL FROM o WHERE name = 'click' AND value > 190")
def stix_and_or(spark, sf_dir):
    p = "[action:name = 'error' AND action:value > 60] AND [action:name = 'signup' AND action:value > 60] OR [action:name = 'click' AND action:value > 190]"
    return stix.bindings(p, _observed(spark, sf_dir), ["user_id"]).select(F.get("ids", F.lit(0)).alias("x"), F.get("ids", F.lit(1)).alias("y"))


@query("visibility", "WITH n AS (SELECT * FROM (VALUES ('t1', 'error'), ('t1', 'click'), ('t2', 'nothing'), ('t2', 'view'), ('t3', 'never')) AS v(technique, source)) SELECT technique, count(s) AS seen, count(*) AS needed, count(s) / count(*) AS score FROM n LEFT JOIN (SELECT DISTINCT event_type AS s FROM events) ON source = s GROUP BY technique")
def visibility(spark, sf_dir):
    needs = spark.createDataFrame([("t1", "error"), ("t1", "click"), ("t2", "nothing"), ("t2", "view"), ("t3", "never")], "technique string, source string")
    return reports.visibility(table(spark, sf_dir, "events"), "event_type", needs)


@query("ndjson", "SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"' || CASE WHEN event_id % 2 = 0 THEN ',\"odd\":1' ELSE '' END || '}' AS value FROM events")
def ndjson(spark, sf_dir):
    return outputs.ndjson(table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, 1).alias("odd")))


@query("rule_draft", "WITH e AS (SELECT * FROM events WHERE event_type = 'error') SELECT 'event_type' AS field, 'error' AS value, count(*) = (SELECT count(*) FROM e) AS whole FROM e")
def rule_draft(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    found = reports.draft(df.where("event_type = 'error'"), df, ["event_type", "user_id", "props"])["selection"]
    matched = detect.evaluate(rules.load(rule(found)), df, keep=["event_type"])
    said = spark.createDataFrame(list(found.items()), "field string, value string")
    return said.crossJoin(matched.agg(F.count_if(F.col("event_type") == "error").alias("n"))).join(df.where("event_type = 'error'").agg(F.count("*").alias("all"))).select("field", "value", (F.col("n") == F.col("all")).alias("whole"))


@query("rule_tune", "SELECT 'kind' AS field, 'odd' AS value, count(*) FILTER (WHERE user_id % 7 = 3) / count(*) AS removes FROM events WHERE event_type = 'error' AND (user_id % 7 = 3 OR user_id = 8)")
def rule_tune(spark, sf_dir):
    df = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("kind", F.when(F.col("user_id") % 7 == 3, "odd").otherwise("even"))
    found = reports.tune(df.where("kind = 'odd' OR user_id = 8"), df.where("kind = 'even' AND user_id <> 8"), ["kind", "event_type"])
    return spark.createDataFrame([(f, v, found["removes"]) for f, v in found["filter"].items()], "field string, value string, removes double")


# --- rules as SQL text ----------------------------------------------------------------------------------------------
def emitted(name: str, text: str, where: str | None = None, sql: str | None = None, grouped: bool = False) -> None:
    """A query that runs the engine's own SQL text over a view of events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table(spark, sf_dir, "events").createOrReplaceTempView("emitted_events")
        rs = rules.load(text)
        if where:
            return spark.sql(emit.query(rs.rules[0], "emitted_events"))
        return spark.sql(emit.correlation(rs.correlations[0], rs, "emitted_events", grouped=grouped))

    query(name, sql or f"SELECT event_id, user_id FROM events WHERE {where}")(run)


emitted("emit_rule", rule(_three, "(a1 or a2) and not b", name="", fields=["event_id", "user_id"]), "(lower(event_type) = 'error' OR value > 50) AND NOT user_id < 40")
emitted("emit_sliding", _errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"]), sql=f"WITH {_hits}, w AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {SPAN} PRECEDING AND CURRENT ROW) AS value FROM h) SELECT * FROM w WHERE value >= 2")
emitted("emit_tumbling", _errors + "\n---\n" + correlation("value_sum", {"gt": 60, "field": "value"}, ["errors"], window="tumbling"), sql=f"WITH {_hits} SELECT user_id, t - t % {SPAN} AS bucket, sum(value) AS value FROM h GROUP BY ALL HAVING sum(value) > 60")
emitted("emit_temporal", "\n---\n".join([_errors, _buys, correlation("temporal", {"gte": 2}, ["errors", "buys"])]), sql=f"WITH {_pair} SELECT user_id, t - t % {SPAN} AS bucket, count(DISTINCT event_type) AS value FROM h GROUP BY ALL HAVING count(DISTINCT event_type) >= 2")


emitted("emit_session", _errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"], gap="1d"), sql=f"WITH {_hits}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS new FROM h), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS value FROM s GROUP BY user_id, sid HAVING max(t) - min(t) <= {SPAN} AND count(*) >= 2")


@query("matched_fields", "SELECT event_id, 'event_type=' || event_type || ',value=' || CAST(value AS VARCHAR) AS found FROM (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS value FROM events) WHERE event_type IN ('error', 'signup') AND value > 50")
def matched_fields(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").alias("value"))
    rs = rules.load(rule({"event_type": ["error", "signup"], "value|gt": 50}))
    pairs = F.transform(detect.matched_fields(rs.rules[0], df), lambda x: F.concat_ws("=", x["field"], x["value"]))
    return df.where(detect.matches(rs.rules[0], df)).select("event_id", F.array_join(pairs, ",").alias("found"))


@query("matched_keywords", "SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'the') OR contains(lower(role), 'the') THEN 'the' END, CASE WHEN contains(lower(text), 'user') OR contains(lower(role), 'user') THEN 'user' END) AS found FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(role), 'the') OR contains(lower(text), 'user') OR contains(lower(role), 'user')")
def matched_keywords(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    rs = rules.load(rule(["the", "user"]))
    found = detect.matched_fields(rs.rules[0], df)
    return df.where(detect.matches(rs.rules[0], df)).select("conv_id", "turn", F.array_join(F.transform(found, lambda x: x["value"]), ",").alias("found"))


@query("corr_full_events", f"WITH {_hits} SELECT a.event_id, sum(b.value) AS total, count(*) AS n FROM h a JOIN h b ON a.user_id = b.user_id AND b.t >= a.t - {SPAN} AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id) GROUP BY a.event_id HAVING count(*) BETWEEN 2 AND 10")
def corr_full_events(spark, sf_dir):
    rs = rules.load(_errors + "\n---\n" + correlation("event_count", {"gte": 2, "lte": 10}, ["errors"]))
    out = correlate.with_events(rs.correlations[0], correlate.hits(rs, table(spark, sf_dir, "events"), "ts", "event_id"), rs, "event_id", full=True)
    total = F.aggregate("event_refs", F.lit(0.0), lambda s, x: s + x["event"]["value"])
    return out.select(F.col("seq").alias("event_id"), total.alias("total"), F.size("event_refs").cast("long").alias("n"))


@query("alert_stages", f"{_runs.replace('FROM a)', 'FROM (SELECT * FROM a WHERE NOT (event_type = {q}click{q} AND ts < 1705500000)))'.format(q=chr(39)))}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY ts, seq) AS i FROM s), k AS (SELECT user_id, ts, seq, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) >= 172800 THEN 1 ELSE 0 END AS new FROM f WHERE i = 1), m AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM k) SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_alerts, count(DISTINCT event_type) AS n_rules FROM m GROUP BY user_id, run")
def alert_stages(spark, sf_dir):
    out = alerts.staged(_alerts(spark, sf_dir), silences=[{"match": {"rule_title": "click"}, "end": 1705500000}], dedup_keys=["user_id", "rule_title"], group_keys=["user_id"], resolve=172800)
    return out.select("user_id", "first_seen", "last_seen", "n_alerts", "n_rules")


@query("dedup_records", f"{_runs}, r AS (SELECT *, row_number() OVER w AS n, min(ts) OVER (PARTITION BY user_id, event_type, run) AS first, lead(ts) OVER w AS later FROM s WINDOW w AS (PARTITION BY user_id, event_type, run ORDER BY ts, seq)), t AS (SELECT *, (ts - first) // 86400 AS turn, lag((ts - first) // 86400) OVER (PARTITION BY user_id, event_type, run ORDER BY ts, seq) AS before FROM r) SELECT user_id, event_type AS rule_title, ts AS at, 'firing' AS kind, n FROM t WHERE n = 1 UNION ALL SELECT user_id, event_type, ts, 'repeat', n FROM t WHERE turn > before UNION ALL SELECT user_id, event_type, ts + 172800, 'resolved', n FROM t WHERE later IS NULL")
def dedup_records(spark, sf_dir):
    return alerts.dedup_records(_alerts(spark, sf_dir), ["user_id", "rule_title"], 172800, 86400)


@query("field_catalogue", "WITH t AS (SELECT unnest(['errors', 'large', 'small', 'small']) AS rule_key, unnest(['event_type', 'value', 'event_type', 'value']) AS field, unnest(['', 'gt', '', 'lt']) AS modifiers) SELECT field, rule_key, 'detection' AS used_as, modifiers, CASE field WHEN 'value' THEN (SELECT count(value) FROM events) ELSE (SELECT count(event_type) FROM events) END AS seen FROM t")
def field_catalogue(spark, sf_dir):
    found = reports.field_catalogue(spark, rules.load(_multi))
    df = table(spark, sf_dir, "events")
    seen = df.agg(F.count("value").alias("value"), F.count("event_type").alias("event_type")).unpivot([], ["value", "event_type"], "name", "seen")
    return found.join(seen, F.col("field") == F.col("name")).drop("name")


@query("deliver_dead_letters", "SELECT CAST(event_id AS VARCHAR) AS value, 'ValueError: refused' AS reason, 2 AS attempts FROM events WHERE event_type = 'error'")
def deliver_dead_letters(spark, sf_dir):
    def send(batch: list[str]) -> None:
        if any(x.startswith("e") for x in batch):
            raise ValueError("refused")

    df = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id")).otherwise(F.col("event_id").cast("string")).alias("value"))
    dead = outputs.deliver(df, send, tries=2, wait=0.0, batch=1)
    return dead.select(F.substring("value", 2, 20).alias("value"), "reason", "attempts")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of errors of one user: at least two within seven days."""
    text = _errors + "\n---\n" + correlation("event_count", {"gte": 2}, ["errors"], span="7d")
    return correlate.correlate(rules.load(text), table(spark, sf_dir, "events"), "ts", "event_id")["c"].drop("tags")


