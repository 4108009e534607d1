"""Alert events, lifecycle, silences and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.functions.time import instant
from signalmill.operators.cep import HIGH_ERROR_RATE
from signalmill.operators.select import for_tenant
from signalmill.operators.skew import previous_value
from signalmill.schemas import ALERTS

# List limits, chat icons and notification texts.
LIST_DEFAULT, LIST_MAX = 100, 500
ICONS = {"critical": ":rotating_light:", "warning": ":warning:"}
OTHER_ICON = ":information_source:"
RESOLVED_ICON = ":white_check_mark:"
NOTIFICATION_SOURCE = "alert-manager"

# Hours under which a spell of silence has rows at most, the slot of longer ones, and the start of those without one.
SLOTTED_HOURS = 48
HOUR_US = 3_600_000_000
LONG = -(1 << 62)
NEVER = -(1 << 62)


def alert_fingerprint(alerts: DataFrame) -> DataFrame:
    """Adds the SHA-256 of tenant, rule and sorted labels; equal alerts share it."""
    pairs = F.transform(
        match.sorted_labels("labels"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit(";"))
    )
    nul = F.char(F.lit(0))
    text = F.concat(
        F.col("tenant_id"), nul, F.col("rule_id"), nul, F.coalesce(F.array_join(pairs, ""), F.lit(""))
    )
    return alerts.withColumn("fingerprint", F.sha2(text, 256))


def cep_to_alerts(events: DataFrame, details: list[str]) -> DataFrame:
    """Rule events as alert events; ``details`` are the columns that become annotations."""
    annotations = F.map_from_arrays(
        F.array(*[F.lit(name) for name in ["service", *details]]),
        F.array(F.col("service_name"), *[F.col(name).cast("string") for name in details]),
    )
    described = F.array_join(
        F.transform(match.sorted_labels("annotations"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))),
        " ",
    )
    return events.select(
        "tenant_id",
        F.concat(F.lit("cep:"), "event_type").alias("rule_id"),
        F.when(F.col("event_type") == HIGH_ERROR_RATE, "critical").otherwise("warning").alias("severity"),
        F.concat("event_type", F.lit(" on "), F.coalesce("service_name", F.lit(""))).alias("title"),
        F.map_filter(
            F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("service"), F.coalesce("service_name", F.lit(""))),
            lambda key, value: (key != "service") | (value != ""),
        ).alias("labels"),
        annotations.alias("annotations"),
        F.lit(False).alias("resolved"),
        F.col("event_time").alias("occurred_at"),
    ).withColumn("description", described)


def burn_description() -> Column:
    return F.format_string(
        "long-window burn rate: %.2fx; short-window: %.2fx; error budget: %.3f%%",
        F.col("burn_long"), F.col("burn_short"), F.col("error_budget") * 100,
    )


def slo_to_alerts(decisions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Decisions as alert events: every burning minute fires, the minute a severity ends resolves it.

    ``slo`` is ``tenant:name``; names may hold colons. ``previous`` holds (slo, minute, severity) of the last decision of
    earlier batches.
    """
    rows = decisions.withColumn("_new", F.lit(True))
    if previous is not None:
        rows = rows.unionByName(
            previous.select("slo", "minute", "severity").withColumn("_new", F.lit(False)), allowMissingColumns=True
        )
    order = Window.partitionBy("slo").orderBy("minute")
    rows = rows.withColumn("_before", F.lag("severity").over(order)).where("_new")
    fired = F.when(F.col("severity") != "ok", F.struct(F.col("severity").alias("severity"), F.lit(False).alias("resolved")))
    ended = F.when(
        (F.col("_before") != "ok") & (F.col("_before") != F.col("severity")),
        F.struct(F.col("_before").alias("severity"), F.lit(True).alias("resolved")),
    )
    events = rows.withColumn("_e", F.explode(F.filter(F.array(ended, fired), lambda e: e.isNotNull())))
    name = F.substr("slo", F.instr("slo", ":") + 1)
    return events.select(
        F.substring_index("slo", ":", 1).alias("tenant_id"),
        F.concat(F.lit("slo:"), name).alias("rule_id"),
        F.col("_e.severity").alias("severity"),
        F.concat(F.lit("SLO burning: "), name).alias("title"),
        burn_description().alias("description"),
        F.create_map(F.lit("slo"), name, F.lit("severity"), F.col("_e.severity")).alias("labels"),
        F.create_map().cast("map<string,string>").alias("annotations"),
        F.col("_e.resolved").alias("resolved"),
        F.timestamp_seconds(F.col("minute") * 60).alias("occurred_at"),
    )


def silence_spells(silences: DataFrame) -> DataFrame:
    """When each matcher of a tenant is silenced: ``_tenant``, ``_anchor``, ``_matcher``, ``_slot``, ``_since``, ``_until``.

    Silences of equal matchers that meet are one spell, so many silences come to few rows. A spell has a row under every hour
    it touches, a longer one than ``SLOTTED_HOURS`` hours one row under ``LONG``: a matcher's long spells lie apart, so their number
    is bounded by the time they cover. ``_anchor`` is a label pair that every covered row has, or empty.
    """
    wanted = F.filter(match.sorted_labels("matcher"), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    blank = F.map_filter("matcher", lambda _, value: F.coalesce(value, F.lit("")) == "")
    own = silences.where(F.col("tenant_id").isNotNull() & F.col("matcher").isNotNull()).select(
        F.col("tenant_id").alias("_tenant"),
        F.when(F.size(wanted) > 0, _pair(F.get(wanted, 0))).otherwise(F.lit("")).alias("_anchor"),
        F.struct(wanted.alias("wanted"), F.array_sort(F.map_keys(blank)).alias("missing")).alias("_matcher"),
        _micros(F.col("created_at") if "created_at" in silences.columns else F.lit(None).cast("timestamp"), NEVER).alias("_since"),
        _micros(F.col("expires_at")).alias("_until"),
    ).where(F.col("_since") < F.col("_until"))
    keys = ["_tenant", "_anchor", "_matcher"]
    own = own.groupBy(*keys, "_since").agg(F.max("_until").alias("_until"))
    # First by the hour of their start, so that a hot matcher is spread over its hours.
    own = _joined_spells(own.withColumn("_hour", _hour("_since")), [*keys, "_hour"])
    own = _joined_spells(own, keys)
    first, last = _hour("_since"), _hour(F.col("_until") - 1)
    slots = F.when(last - first < SLOTTED_HOURS, F.sequence(first, last)).otherwise(F.array(F.lit(LONG)))
    return own.withColumn("_slot", F.explode(slots))


def _joined_spells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (``_since``, ``_until``) of equal keys, those that overlap or meet as one."""
    order = Window.partitionBy(*keys).orderBy("_since")
    before = F.max("_until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("_since") > before, F.lit(True)).cast("long"))
    rows = rows.withColumn("_spell", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_spell").agg(F.min("_since").alias("_since"), F.max("_until").alias("_until")).drop("_spell")


def _micros(at: Column, none: int | None = None) -> Column:
    us = F.unix_micros(at.cast("timestamp"))
    return us if none is None else F.coalesce(us, F.lit(none))


def _hour(us: Column | str) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return ((us - F.pmod(us, F.lit(HOUR_US))) / F.lit(HOUR_US)).cast("long")


def _pair(entry: Column) -> Column:
    return F.concat(entry["key"], F.lit("="), entry["value"])


def label_anchors(labels: Column) -> Column:
    """The anchors under which silences of a row with these labels are found."""
    return F.array_union(F.array(F.lit("")), F.filter(F.transform(F.map_entries(labels), _pair), lambda p: p.isNotNull()))


def slot_of(at: Column) -> Column:
    return _hour(_micros(at))


def spell_covers(spell: Column, labels: Column, at: Column) -> Column:
    """Whether a spell (``_matcher``, ``_since``, ``_until``) covers labels at a time."""
    own = lambda key: F.coalesce(F.element_at(labels, key), F.lit(""))
    same = F.forall(spell["_matcher"]["wanted"], lambda e: own(e["key"]) == e["value"])
    blank = F.forall(spell["_matcher"]["missing"], lambda key: own(key) == "")
    return (spell["_since"] <= _micros(at)) & (spell["_until"] > _micros(at)) & same & blank


def silence_hits(rows: DataFrame, ids: list[str], at: Column, silences: DataFrame) -> DataFrame:
    """Distinct ``ids`` of rows (tenant_id, labels) that an active silence of their tenant covers.

    A silence covers a row when its matcher is a subset of the labels, a missing label reading as
    the empty string; an empty matcher covers everything. Spells of silence are looked up under one of
    their label pairs and the hour, so the join is an equi-join on (tenant, pair, slot).
    """
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    r = rows.select(*ids, "tenant_id", labels.alias("labels"), at.alias("_at")).where(F.col("_at").isNotNull())
    r = r.withColumn("_key", F.explode(label_anchors(F.col("labels"))))
    r = r.withColumn("_in", F.explode(F.array(slot_of(F.col("_at")), F.lit(LONG))))
    spell = {name: F.col(name) for name in ("_matcher", "_since", "_until")}
    same = (F.col("tenant_id") == F.col("_tenant")) & (F.col("_key") == F.col("_anchor")) & (F.col("_in") == F.col("_slot"))
    return r.join(silence_spells(silences), same & spell_covers(spell, F.col("labels"), F.col("_at")), "left_semi").select(*ids).distinct()


def silenced_alerts(alerts: DataFrame, silences: DataFrame, *, as_of) -> DataFrame:
    """Alerts that an active silence covers at ``as_of``."""
    hits = silence_hits(alerts, ["fingerprint"], instant(as_of), silences)
    return alerts.join(hits, "fingerprint", "left_semi")


def unsilenced_alerts(alerts: DataFrame, silences: DataFrame, *, as_of) -> DataFrame:
    hits = silence_hits(alerts, ["fingerprint"], instant(as_of), silences)
    return alerts.join(hits, "fingerprint", "left_anti")


def alert_steps(events: DataFrame, row_id: str = "event_id", carried: DataFrame | None = None) -> DataFrame:
    """Alert events with the step each takes for its alert: created, updated, resolved or none.

    An alert is created by its first firing and by the first firing after a resolve; a resolve only
    counts for a firing alert. ``carried`` (fingerprint, firing) is the state before these events.
    """
    rows = events if "fingerprint" in events.columns else alert_fingerprint(events)
    rows = rows.withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    rows = previous_value(rows, ["fingerprint"], "occurred_at", row_id, "resolved", "_prev")
    if carried is not None:
        rows = rows.join(carried.select("fingerprint", "firing"), "fingerprint", "left")
        rows = rows.withColumn("_prev", F.coalesce("_prev", ~F.col("firing"))).drop("firing")
    firing_before = F.coalesce(~F.col("_prev"), F.lit(False))
    step = (
        F.when(F.col("resolved") & firing_before, "resolved")
        .when(~F.col("resolved") & firing_before, "updated")
        .when(~F.col("resolved"), "created")
    )
    return rows.withColumn("step", step).drop("_prev")


def transitions(steps: DataFrame) -> DataFrame:
    """One row per firing event: whether it is a new transition."""
    return steps.where(F.col("step").isin("created", "updated")).select(
        "fingerprint", "occurred_at", (F.col("step") == "created").alias("new_transition")
    )


def _noted(steps: DataFrame, silences: DataFrame | None, row_id: str) -> DataFrame:
    """``steps`` with ``_silenced``, true where a silence covers the creation of an alert and else null."""
    if silences is None:
        return steps.withColumn("_silenced", F.lit(None).cast("boolean"))
    hits = silence_hits(steps.where("step = 'created'"), [row_id], F.col("occurred_at"), silences)
    return steps.join(hits.withColumn("_silenced", F.lit(True)), row_id, "left")


def alert_lifecycle(
    steps: DataFrame, silences: DataFrame | None = None, row_id: str = "event_id"
) -> DataFrame:
    """Final alert rows.

    Severity, texts and labels are those of the last transition; a refresh only moves last_seen_at.
    """
    noted = _noted(steps, silences, row_id)
    order = F.struct("occurred_at", row_id)
    created = F.col("step") == "created"
    fired = F.col("step").isin("created", "updated")
    notified = created & F.col("_silenced").isNull()
    texts = ["tenant_id", "rule_id", "severity", "title", "description", "labels", "annotations"]
    final = noted.groupBy("fingerprint").agg(
        F.max_by(F.struct(*texts, F.col("occurred_at").alias("starts_at")), F.when(created, order)).alias("a"),
        F.max(F.when(fired, F.col("occurred_at"))).alias("last_seen_at"),
        F.max_by("resolved", F.when(F.col("step").isNotNull(), order)).alias("_resolved"),
        F.max(F.when(F.col("step") == "resolved", F.col("occurred_at"))).alias("_resolved_at"),
        F.max(F.when(notified, F.col("occurred_at"))).alias("notified_at"),
        F.count_if(notified).alias("notify_count"),
    )
    return final.where(F.col("a").isNotNull()).select(
        "fingerprint",
        *[f"a.{c}" for c in texts],
        F.when(F.col("_resolved"), "resolved").otherwise("firing").alias("state"),
        F.col("a.starts_at").alias("starts_at"),
        "last_seen_at",
        F.when(F.col("_resolved"), F.col("_resolved_at")).alias("resolved_at"),
        "notified_at",
        "notify_count",
    ).select(*ALERTS.names)


def alert_history(steps: DataFrame, silences: DataFrame | None = None, row_id: str = "event_id") -> DataFrame:
    """created / updated / resolved rows, and notified rows for unsilenced transitions."""
    noted = _noted(steps.where(F.col("step").isNotNull()), silences, row_id)
    severity = F.when(F.col("step") != "resolved", F.col("severity"))
    step = F.struct(F.col("step").alias("event"), severity.alias("severity"))
    notified = F.when(
        (F.col("step") == "created") & F.col("_silenced").isNull(),
        F.struct(F.lit("notified").alias("event"), F.lit(None).cast("string").alias("severity")),
    )
    noted = noted.withColumn("_e", F.explode(F.filter(F.array(step, notified), lambda e: e.isNotNull())))
    return noted.select("fingerprint", "tenant_id", "_e.event", "_e.severity", "occurred_at")


def _chat_payload() -> Column:
    icon = F.lit(OTHER_ICON)
    for severity, name in ICONS.items():
        icon = F.when(F.col("severity") == severity, name).otherwise(icon)
    icon = F.when(F.col("resolved"), RESOLVED_ICON).otherwise(icon)
    state = F.when(F.col("resolved"), "RESOLVED").otherwise("FIRING")
    text = F.concat(
        icon, F.lit(" *["), state, F.lit("]["), F.col("severity"), F.lit("] "), F.col("title"),
        F.lit("* — tenant `"), F.col("tenant_id"), F.lit("`\n"), F.coalesce("description", F.lit("")),
    )
    return F.to_json(F.struct(text.alias("text")))


def _pager_payload(routing_key: str) -> Column:
    return F.to_json(
        F.struct(
            F.lit(routing_key).alias("routing_key"),
            _action().alias("event_action"),
            F.col("fingerprint").alias("dedup_key"),
            F.struct(
                F.col("title").alias("summary"),
                F.lit(NOTIFICATION_SOURCE).alias("source"),
                F.col("severity").alias("severity"),
                F.struct("tenant_id", "description", "labels", "annotations").alias("custom_details"),
            ).alias("payload"),
        )
    )


def _generic_payload() -> Column:
    return F.to_json(
        F.struct(
            "fingerprint", "tenant_id", "severity", "title", "description",
            F.lit(NOTIFICATION_SOURCE).alias("source"), "labels", "annotations",
            F.col("occurred_at").alias("starts_at"),
            F.when(F.col("resolved"), F.col("occurred_at")).alias("ends_at"),
        )
    )


def _action() -> Column:
    return F.when(F.col("resolved"), "resolve").otherwise("trigger")


def notification_outbox(
    steps: DataFrame,
    silences: DataFrame | None,
    channels: dict[str, str],
    row_id: str = "event_id",
    routing_key: str = "",
) -> DataFrame:
    """Messages to deliver: one per channel for every unsilenced transition and every resolve event.

    ``channels`` maps a channel name to its kind: ``chat``, ``pager`` or ``webhook``.
    """
    created = steps.where("step = 'created'")
    if silences is not None:
        created = created.join(silence_hits(created, [row_id], F.col("occurred_at"), silences), row_id, "left_anti")
    rows = created.unionByName(steps.where("resolved").select(*created.columns))
    payloads = {"chat": _chat_payload(), "pager": _pager_payload(routing_key), "webhook": _generic_payload()}
    messages = F.array(
        *[F.struct(F.lit(name).alias("channel"), payloads[kind].alias("payload")) for name, kind in channels.items()]
    )
    return rows.withColumn("_m", F.explode(messages)).select(
        "fingerprint", "_m.channel", _action().alias("action"), "_m.payload", "occurred_at", row_id
    )


def recent_alerts(alerts: DataFrame, tenant: str, k: int = LIST_DEFAULT) -> DataFrame:
    k = LIST_DEFAULT if k <= 0 or k > LIST_MAX else k
    return for_tenant(alerts, tenant).orderBy(F.desc("last_seen_at"), "fingerprint").limit(k)
