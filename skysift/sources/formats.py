"""Log lines -> columns, with built-in functions: JSON, syslog, CEF, logfmt, plain text, and telling them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_3164 = r"^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\w+)\])?: ?([\s\S]*)$"
_5424 = r'^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\"]|\\.|"(?:[^"\\]|\\.)*+")*+\])+) ?([\s\S]*)$'
_LOGFMT = r'([^\s="]+)(=)?(?:(?<==)(?:"((?:[^"\\]|\\.)*+)"|([^\s"]*)))?'
_CEF = r"CEF:(\d+)" + r"\|([^|\\]*+(?:\\.[^|\\]*+)*+)" * 6 + r"\|([\s\S]*)$"


def _nil(c: Column) -> Column:
    return F.when((c != "-") & (c != ""), c)


def _once(x: Column, f) -> Column:
    """f(x), with x computed once: a lambda binds it, whereas a column is inlined wherever it is mentioned."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _groups(raw: Column, pattern: str, n: int) -> Column:
    return F.struct(*(F.regexp_extract(raw, pattern, i).alias(f"g{i}") for i in range(1, n + 1)))


def _last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays in which keys may repeat; the last value of a key counts."""
    distinct = F.array_distinct(keys)
    last = F.transform(distinct, lambda k: F.element_at(values, -F.array_position(F.reverse(keys), k).cast("int")))
    return F.when(F.size(distinct) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(distinct, last))


def json(df: DataFrame, line: str = "value") -> DataFrame:
    """Adds `event`, a variant; null where the line is no JSON (those are the dead letters)."""
    return df.withColumn("event", F.try_parse_json(F.col(line)))


def syslog(df: DataFrame, line: str = "value", offset: str = "+00:00", now: Column | None = None) -> DataFrame:
    """RFC 5424 and 3164 lines -> struct `syslog`(facility, severity, timestamp, hostname, appname, procid, msgid, sd, message, ts, event).

    sd maps `<sd-id>.<param>` to its value; a repeated parameter's last value counts. ts is in epoch seconds: RFC 3164
    names neither year nor zone, so `offset` is its zone, and its year that of `now` (a timestamp; the current time), or
    the year before if that would lie more than a day ahead (December read in January). A JSON object as message is
    parsed into event, together with the header as syslog_hostname, syslog_appname, syslog_procid, syslog_msgid,
    syslog_facility and syslog_severity. Null where the line is neither.
    """
    raw = F.regexp_replace(F.col(line), "^\ufeff", "")
    now = F.current_timestamp() if now is None else now
    groups = lambda r: F.struct(r.alias("raw"), F.when(r.rlike(_5424), _groups(r, _5424, 8)).alias("new"), F.when(~r.rlike(_5424) & r.rlike(_3164), _groups(r, _3164, 6)).alias("old"))
    return df.withColumn("syslog", _once(_once(raw, groups), lambda m: _syslog(m, offset, now)))


def _syslog(m: Column, offset: str, now: Column) -> Column:
    raw, new, old = m["raw"], m["new"].isNotNull(), m["old"].isNotNull()
    g = lambda p, i: m["new" if p == _5424 else "old"][f"g{i}"]
    pri = F.when(new, g(_5424, 1)).when(old, g(_3164, 1)).try_cast("int")
    sd_raw = F.when(new, g(_5424, 7))
    elements = F.regexp_extract_all(sd_raw, F.lit(r'\[((?:[^\]\\"]|\\.|"(?:[^"\\]|\\.)*+")*+)\]'), F.lit(1))
    pattern = r'(\S+?)="((?:[^"\\]|\\.)*)"'

    def names(e: Column) -> Column:
        of = F.regexp_extract(e, r"^(\S+)", 1)
        return F.transform(F.regexp_extract_all(e, F.lit(pattern), F.lit(1)), lambda k: F.concat(of, F.lit("."), k))

    def values(e: Column) -> Column:
        return F.transform(F.regexp_extract_all(e, F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1"))

    pairs = _once(elements, lambda e: F.struct(F.flatten(F.transform(e, names)).alias("names"), F.flatten(F.transform(e, values)).alias("values")))
    sd = _once(pairs, lambda p: _last_wins(p["names"], p["values"]))
    message = F.when(new, g(_5424, 8)).when(old, g(_3164, 6))
    stamp = F.when(new, _nil(g(_5424, 2))).otherwise(g(_3164, 2))
    # a leap day has no date in other years, so the year comes before parsing
    dated = lambda y: F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), F.regexp_replace(g(_3164, 2), r"\s+", " "), F.lit(f" {offset}")), F.lit("yyyy MMM d HH:mm:ss xxx"))
    this = dated(F.year(now))
    past = F.when(this.isNull() | (this > now + F.expr("INTERVAL 1 DAY")), dated(F.year(now) - 1)).otherwise(this)
    ts = F.when(new, F.unix_seconds(_nil(g(_5424, 2)).try_cast("timestamp"))).otherwise(F.unix_seconds(past))
    fields = {
        "facility": F.floor(pri / 8).cast("int"), "severity": pri % 8, "timestamp": stamp, "hostname": F.when(new, _nil(g(_5424, 3))).otherwise(g(_3164, 3)), "appname": F.when(new, _nil(g(_5424, 4))).otherwise(g(_3164, 4)),
        "procid": F.when(new, _nil(g(_5424, 5))).otherwise(_nil(g(_3164, 5))), "msgid": F.when(new, _nil(g(_5424, 6))), "sd": sd, "message": message, "ts": ts,
    }
    head = F.to_json(F.struct(*(fields[n].alias(f"syslog_{n}") for n in ("facility", "severity", "hostname", "appname", "procid", "msgid"))))
    body = F.substring(F.ltrim(message), 2, F.length(message))
    merged = F.when(body.rlike(r"^\s*\}\s*$"), head).otherwise(F.concat(F.left(head, F.length(head) - 1), F.lit(","), body))
    event = F.when(F.ltrim(message).startswith("{"), F.try_parse_json(merged))
    return F.when((new | old) & (pri <= 191), F.struct(*(c.alias(n) for n, c in fields.items()), event.alias("event"), raw.alias("_raw")))


def logfmt(df: DataFrame, line: str = "value") -> DataFrame:
    """key=value pairs -> map `logfmt`; a bare key is "true", `k=` is empty; later keys win. Values are taken whole."""
    groups = [F.regexp_extract_all(F.col(line), F.lit(_LOGFMT), F.lit(i)).alias(f"p{i}") for i in range(1, 5)]
    # the matches are a column of their own: inlined, the patterns would run again wherever they are mentioned
    work = "__pairs"
    while work in df.columns:
        work += "_"
    p = F.col(work)
    named = F.zip_with(p["p2"], p["p4"], lambda eq, plain: F.when(eq == "", "true").otherwise(plain))
    values = F.zip_with(named, p["p3"], lambda v, quoted: F.when(quoted != "", F.regexp_replace(quoted, r'\\(["\\])', "$1")).otherwise(v))
    out = df.withColumn(work, F.struct(*groups)).withColumn(f"{work}v", values)
    return out.withColumn("logfmt", F.when(F.size(p["p1"]) > 0, _last_wins(p["p1"], F.col(f"{work}v")))).drop(work, f"{work}v")


def cef(df: DataFrame, line: str = "value") -> DataFrame:
    """CEF, also inside a syslog line -> struct `cef`(version, vendor, product, device_version, signature, name, severity, extensions map)."""
    raw = F.col(line)
    # a value runs up to the next ` key=`
    pattern = r"(?:^|\s)([A-Za-z0-9_.\[\]-]+)=((?:\\.|[^\\=])*?)(?=\s+[A-Za-z0-9_.\[\]-]+=|\s*$)"

    def fields(g: Column) -> Column:
        head = lambda i: F.regexp_replace(g[f"g{i}"], r"\\([|\\])", "$1")
        keys = F.regexp_extract_all(g["g8"], F.lit(pattern), F.lit(1))
        values = F.transform(F.regexp_extract_all(g["g8"], F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(F.regexp_replace(v, r"\\n", "\n"), r"\\([=\\])", "$1"))
        extensions = _once(F.struct(keys.alias("names"), values.alias("values")), lambda p: _last_wins(p["names"], p["values"]))
        named = zip(("vendor", "product", "device_version", "signature", "name", "severity"), range(2, 8), strict=True)
        return F.when(g.isNotNull(), F.struct(g["g1"].try_cast("int").alias("version"), *(head(i).alias(n) for n, i in named), extensions.alias("extensions")))

    return df.withColumn("cef", _once(F.when(raw.rlike(_CEF), _groups(raw, _CEF, 8)), fields))


def kind(line: Column) -> Column:
    """json, syslog, cef, logfmt or plain, by content."""
    s = F.ltrim(line)
    return (
        F.when((s.startswith("{") | s.startswith("[")) & F.try_parse_json(s).isNotNull(), "json")
        .when(line.rlike(r"CEF:\d+\|"), "cef").when(line.rlike(_5424) | line.rlike(_3164), "syslog")
        .when(line.rlike(r'^[\w.]+=(?:"|\S)') & (F.size(F.regexp_extract_all(line, F.lit(r"[\w.]+="), F.lit(0))) >= 2), "logfmt").otherwise("plain")
    )


def auto(df: DataFrame, line: str = "value") -> DataFrame:
    """Blank lines go; adds `format` and the parsed columns of each format, null for lines of another."""
    out = df.where(F.length(F.trim(F.col(line))) > 0).withColumn("format", kind(F.col(line)))
    own = "__line"
    while own in df.columns:
        own += "_"
    for name, parse in (("json", json), ("syslog", syslog), ("cef", cef), ("logfmt", logfmt)):
        # a parser sees the lines of its format only
        out = parse(out.withColumn(own, F.when(F.col("format") == name, F.col(line))), own)
    return out.drop(own)


def envelope(df: DataFrame, event: str, path: str) -> DataFrame:
    """One row for each element of the JSON array at path (`$.records`), as variant `event`; a single value is one row."""
    inner = F.try_variant_get(F.col(event), path, "variant")
    many = F.try_variant_get(F.col(event), path, "array<variant>")
    rest = [c for c in df.columns if c != event]
    return df.select(*rest, F.explode_outer(F.coalesce(many, F.array(inner))).alias("event")).where("event IS NOT NULL")


def otlp(df: DataFrame, event: str = "event") -> DataFrame:
    """OTLP log exports (JSON, as variant) -> rows (resource, scope, attributes: maps; severity, body, ts in epoch seconds, trace_id, span_id).

    Scalar values are text as they stand; bytes their base64; arrays and key-value lists their JSON. The last of
    repeated attributes counts. ts is the record's time, else the time it was observed.
    """
    get = lambda c, p, t="variant": F.try_variant_get(c, p, t)

    def value(v: Column) -> Column:
        plain = [get(v, f"$.{k}Value", "string") for k in ("string", "int", "double", "bool", "bytes")]
        nested = [F.to_json(get(v, p)) for p in ("$.arrayValue.values", "$.kvlistValue.values")]
        return F.coalesce(*plain, *nested)

    def attributes(c: Column) -> Column:
        pairs = F.coalesce(get(c, "$.attributes", "array<variant>"), F.array().cast("array<variant>"))
        pairs = F.filter(pairs, lambda a: get(a, "$.key", "string").isNotNull())
        return _last_wins(F.transform(pairs, lambda a: get(a, "$.key", "string")), F.transform(pairs, lambda a: value(get(a, "$.value"))))

    r = df.select(F.explode_outer(get(F.col(event), "$.resourceLogs", "array<variant>")).alias("r"))
    s = r.select(attributes(get(F.col("r"), "$.resource")).alias("resource"), F.explode_outer(get(F.col("r"), "$.scopeLogs", "array<variant>")).alias("s"))
    rec = s.select("resource", get(F.col("s"), "$.scope.name", "string").alias("scope"), F.explode_outer(get(F.col("s"), "$.logRecords", "array<variant>")).alias("x")).where("x IS NOT NULL")
    x = F.col("x")
    nanos = F.coalesce(F.nullif(get(x, "$.timeUnixNano", "string"), F.lit("0")), get(x, "$.observedTimeUnixNano", "string"))
    return rec.select(
        "resource", "scope", attributes(x).alias("attributes"), get(x, "$.severityText", "string").alias("severity"), value(get(x, "$.body")).alias("body"),
        F.floor(nanos.cast("decimal(20,0)") / 1_000_000_000).cast("long").alias("ts"), get(x, "$.traceId", "string").alias("trace_id"), get(x, "$.spanId", "string").alias("span_id"),
    )
