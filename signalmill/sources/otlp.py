"""OTLP-JSON files as spans, metric rows and log rows.

Every file line is one export request. Records are exploded where they lie; resource, scope and
record attributes end up in one string map in which the record wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions.time import instant

# Fixed value: log records from this severity number on are errors.
ERROR_SEVERITY = 17

# Names of the enumerations that records carry as numbers.
_SPAN_KINDS = (
    "SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER",
    "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER",
)
_TEMPORALITIES = (
    "AGGREGATION_TEMPORALITY_UNSPECIFIED", "AGGREGATION_TEMPORALITY_DELTA", "AGGREGATION_TEMPORALITY_CUMULATIVE",
)
_ERROR_STATUS = ("2", "STATUS_CODE_ERROR")

# Numbers are read as strings: 64-bit integers may be quoted, and their text is kept as it is.
_SCALARS = "stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string"
# An array value stays the JSON text it is, whatever its depth; it is rendered from its tokens.
_ANY = f"struct<{_SCALARS},arrayValue:string>"
_ATTRS = f"array<struct<key:string,value:{_ANY}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRS}>"
_SCOPE = "scope:struct<name:string>"
_SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},"
    "status:struct<code:string,message:string>>"
)
_POINT = (
    f"struct<attributes:{_ATTRS},timeUnixNano:string,asDouble:string,asInt:string,count:string,sum:string>"
)
_METRIC = (
    "struct<name:string,unit:string,description:string,"
    f"gauge:struct<dataPoints:array<{_POINT}>>,"
    f"sum:struct<dataPoints:array<{_POINT}>,aggregationTemporality:string>,"
    f"histogram:struct<dataPoints:array<{_POINT}>>,"
    f"exponentialHistogram:struct<dataPoints:array<{_POINT}>>,"
    f"summary:struct<dataPoints:array<{_POINT}>>>"
)
_RECORD = (
    "struct<timeUnixNano:string,severityText:string,severityNumber:string,traceId:string,spanId:string,"
    f"body:{_ANY},attributes:{_ATTRS}>"
)
SCHEMAS = {
    "traces": f"resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<{_SCOPE},spans:array<{_SPAN}>>>>>",
    "metrics": f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<{_SCOPE},metrics:array<{_METRIC}>>>>>",
    "logs": f"resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<{_SCOPE},logRecords:array<{_RECORD}>>>>>",
}


def read_otlp(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(SCHEMAS[kind])
    return reader.json(path)


def plain_double(text: Column) -> Column:
    """A double without exponent and without a trailing ``.0``."""
    number = text.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    decimal = F.regexp_replace(number.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    plain = (F.abs(number) >= 1e-3) & (F.abs(number) < 1e7)
    return (
        F.when(whole, number.try_cast("long").cast("string"))
        .when(plain, number.cast("string"))
        .otherwise(F.coalesce(decimal, number.cast("string"), text))
    )


def _scalar_text(value: Column) -> Column:
    return F.coalesce(
        value["stringValue"],
        value["boolValue"],
        value["intValue"],
        plain_double(value["doubleValue"]),
        F.lower(F.hex(F.try_to_binary(value["bytesValue"], F.lit("base64")))),
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# A quoted JSON text; possessive, so that long ones need no stack.
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_SCALAR = rf'"(?:string|bool|int|double|bytes)Value":(?:{_QUOTED}|[^",\[\]{{}}]++)'
# What an array is rendered from: scalars, empty arrays, brackets and the commas between items. Keys are matched to be passed over.
_PARTS = rf'{_SCALAR}|"arrayValue":\{{\}}|{_QUOTED}:?|[\[\]]|,(?=[{{n])'


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _array_text(array: Column) -> Column:
    """An array value given as JSON text: ``[a,b]``, nested as deep as it is."""

    def part(token: Column) -> Column:
        scalar = F.from_json(F.concat(F.lit("{"), token, F.lit("}")), f"struct<{_SCALARS}>")
        return (
            F.when(token.isin("[", "]", ","), token)
            .when(token == '"arrayValue":{}', "[]")
            .when(token.rlike(f"^{_SCALAR}$"), F.coalesce(_scalar_text(scalar), F.lit("")))
            .otherwise("")
        )

    def rendered(text: Column) -> Column:
        known = F.when(text.contains('"kvlistValue":'), _without_lists_of_pairs(text)).otherwise(text)
        return F.when(text == "{}", "[]").otherwise(F.array_join(F.transform(_tokens(known, _PARTS), part), ""))

    return _bound(F.array_join(_tokens(array, rf'{_QUOTED}|[^\s"]++'), ""), rendered)


def _without_lists_of_pairs(text: Column) -> Column:
    """JSON text without the lists of pairs in it, which have no text of their own."""

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        opened = (state["since"] == 0) & (token == '"kvlistValue":')
        closed = (token == "}") & (depth <= state["since"])
        since = F.when(opened, state["depth"]).when(closed, 0).otherwise(state["since"])
        kept = F.when(opened | (state["since"] > 0), state["kept"]).otherwise(F.concat(state["kept"], token))
        return F.struct(kept.alias("kept"), depth.alias("depth"), since.alias("since"))

    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("depth"), F.lit(0).alias("since"))
    return F.aggregate(_tokens(text, rf'{_QUOTED}:?|[{{}}]|[^"{{}}]++'), start, step, lambda state: state["kept"])


def any_value_text(value: Column) -> Column:
    """An attribute value as text; arrays as ``[a,b]`` however nested, bytes as hex, lists of pairs empty."""
    array = F.when(value["arrayValue"].isNotNull(), _array_text(value["arrayValue"]))
    return F.coalesce(_scalar_text(value), array, F.lit(""))


def _entries(attributes: Column) -> Column:
    named = F.filter(attributes, lambda kv: F.coalesce(kv["key"], F.lit("")) != "")
    entry = lambda kv: F.struct(kv["key"].alias("key"), any_value_text(kv["value"]).alias("value"))
    return F.coalesce(F.transform(named, entry), F.array().cast("array<struct<key:string,value:string>>"))


def last_wins(entries: Column) -> Column:
    """Entries as a map in which a later entry replaces an earlier one of the same key."""

    def of(own: Column) -> Column:
        later = lambda e, i: F.exists(F.slice(own, i + F.lit(2), F.size(own)), lambda o: o["key"] == e["key"])
        return F.map_from_entries(F.filter(own, lambda e, i: ~later(e, i)))

    # Bound once: named within the filter, the entries would be worked out anew for each of them.
    return _bound(entries, of)


def _optional(name: str, value: Column) -> Column:
    """No entry, or one."""
    entry = F.array(F.struct(F.lit(name).alias("key"), value.alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.when(F.coalesce(value, F.lit("")) != "", entry).otherwise(none)


def _nanos(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def _micros_time(nanos: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))


def _enum_name(text: Column, names: tuple[str, ...]) -> Column:
    number = F.coalesce(text.try_cast("int"), F.lit(-1))
    return F.when(text.isNull(), names[0]).otherwise(
        F.coalesce(F.get(F.array(*map(F.lit, names)), number), text)
    )


def otlp_traces(df_json: DataFrame, tenant: str, received_at) -> DataFrame:
    """One row per span with its real start and end; an error status sets severity and status."""
    scopes = df_json.select(F.explode("resourceSpans").alias("r")).select(
        F.col("r.resource.attributes").alias("_ra"), F.explode("r.scopeSpans").alias("s")
    )
    spans = scopes.select("_ra", F.col("s.scope.name").alias("_scope"), F.explode("s.spans").alias("p"))
    start, end = _nanos(F.col("p.startTimeUnixNano")), _nanos(F.col("p.endTimeUnixNano"))
    duration = F.when(end > start, end - start)
    is_error = F.col("p.status.code").isin(list(_ERROR_STATUS))
    attributes = F.concat(
        _entries(F.col("_ra")),
        _entries(F.col("p.attributes")),
        _optional("otel.scope.name", F.col("_scope")),
        _optional("span.kind", _enum_name(F.col("p.kind"), _SPAN_KINDS)),
        _optional("duration_ms", F.when(duration.isNotNull(), F.format_string("%.3f", duration / 1e6))),
        _optional("severity", F.when(is_error, F.lit("ERROR"))),
        _optional("status.message", F.col("p.status.message")),
    )
    rows = spans.select(
        F.lit(tenant).alias("tenant_id"),
        F.lower(F.coalesce("p.traceId", F.lit(""))).alias("trace_id"),
        F.lower(F.coalesce("p.spanId", F.lit(""))).alias("span_id"),
        F.lower(F.coalesce("p.parentSpanId", F.lit(""))).alias("parent_span_id"),
        F.coalesce("p.name", F.lit("")).alias("operation_name"),
        F.when(start > 0, _micros_time(start)).otherwise(instant(received_at)).alias("start_time"),
        F.when(end > start, _micros_time(end))
        .when(start > 0, _micros_time(start))
        .otherwise(instant(received_at))
        .alias("end_time"),
        F.coalesce(duration, F.lit(0).cast("long")).alias("duration_ns"),
        last_wins(attributes).alias("attributes"),
        F.when(is_error, "ERROR").when(F.col("p.status.code").isin("1", "STATUS_CODE_OK"), "OK").otherwise("").alias("status_code"),
    )
    return rows.withColumn("service_name", _service()).select(
        "tenant_id", "trace_id", "span_id", "parent_span_id", "operation_name", "service_name",
        "start_time", "end_time", "duration_ns", "attributes", "status_code",
    )


def _service() -> Column:
    found = [F.nullif(F.element_at("attributes", F.lit(k)), F.lit("")) for k in ("service.name", "service_name")]
    return F.coalesce(*found, F.lit(""))


def otlp_metrics(df_json: DataFrame, tenant: str, received_at) -> DataFrame:
    """One row per data point; histograms and summaries give their count and sum, and value = sum."""
    scopes = df_json.select(F.explode("resourceMetrics").alias("r")).select(
        F.col("r.resource.attributes").alias("_ra"), F.explode("r.scopeMetrics").alias("s")
    )
    metrics = scopes.select("_ra", F.col("s.scope.name").alias("_scope"), F.explode("s.metrics").alias("m"))
    kinds = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
    points = F.coalesce(*[F.col(f"m.{kind}.dataPoints") for kind in kinds])
    is_number = F.col("m.gauge").isNotNull() | F.col("m.sum").isNotNull()
    rows = metrics.select(
        "_ra", "_scope", "m.name", "m.unit", "m.description",
        is_number.alias("_number"),
        F.when(
            F.col("m.sum").isNotNull(), _enum_name(F.col("m.sum.aggregationTemporality"), _TEMPORALITIES)
        ).alias("temporality"),
        F.explode(points).alias("p"),
    )
    nanos = _nanos(F.col("p.timeUnixNano"))
    at = F.when(nanos > 0, _micros_time(nanos)).otherwise(instant(received_at))
    number = F.coalesce(F.col("p.asDouble").try_cast("double"), F.col("p.asInt").try_cast("double"))
    total = F.coalesce(F.col("p.sum").try_cast("double"), F.lit(0.0))
    count = F.coalesce(F.col("p.count").try_cast("long"), F.lit(0).cast("long"))
    labels = F.concat(
        _entries(F.col("_ra")),
        _optional("otel.scope.name", F.col("_scope")),
        _optional("metric_unit", F.col("unit")),
        _optional("metric_description", F.col("description")),
        _entries(F.col("p.attributes")),
    )
    return rows.select(
        F.lit(tenant).alias("tenant_id"),
        F.coalesce("name", F.lit("")).alias("metric_name"),
        at.alias("timestamp"),
        F.coalesce(F.when(F.col("_number"), number).otherwise(total), F.lit(0.0)).alias("value"),
        last_wins(labels).alias("labels"),
        at.alias("received_at"),
        F.when(~F.col("_number"), count).alias("count"),
        F.when(~F.col("_number"), total).alias("sum"),
        "temporality",
        "unit",
    )


def otlp_logs(df_json: DataFrame, tenant: str, received_at) -> DataFrame:
    """One row per log record; the severity text, else ERROR from its number."""
    scopes = df_json.select(F.explode("resourceLogs").alias("r")).select(
        F.col("r.resource.attributes").alias("_ra"), F.explode("r.scopeLogs").alias("s")
    )
    records = scopes.select("_ra", F.col("s.scope.name").alias("_scope"), F.explode("s.logRecords").alias("l"))
    number = F.regexp_replace("l.severityNumber", "^SEVERITY_NUMBER_", "")
    by_name = number.rlike("^(ERROR|FATAL)")
    severity = F.coalesce(
        F.nullif("l.severityText", F.lit("")),
        F.when(by_name | (number.try_cast("int") >= ERROR_SEVERITY), F.lit("ERROR")),
    )
    attributes = F.concat(
        _entries(F.col("_ra")),
        _entries(F.col("l.attributes")),
        _optional("otel.scope.name", F.col("_scope")),
        _optional("severity", severity),
        _optional("trace_id", F.lower("l.traceId")),
        _optional("span_id", F.lower("l.spanId")),
    )
    nanos = _nanos(F.col("l.timeUnixNano"))
    rows = records.select(
        F.lit(tenant).alias("tenant_id"),
        any_value_text(F.col("l.body")).alias("body"),
        last_wins(attributes).alias("attributes"),
        F.when(nanos > 0, _micros_time(nanos)).otherwise(instant(received_at)).alias("timestamp"),
    )
    return rows.select(
        "tenant_id",
        _service().alias("service_name"),
        *[F.coalesce(F.element_at("attributes", F.lit(k)), F.lit("")).alias(k) for k in ("severity",)],
        "body",
        "attributes",
        "timestamp",
        *[F.coalesce(F.element_at("attributes", F.lit(k)), F.lit("")).alias(k) for k in ("trace_id", "span_id")],
    )
