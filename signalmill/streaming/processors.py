"""What a key's state variables are, and how a micro-batch's rows of the key change them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalmill.operators.ewma import fold_on
from signalmill.streaming.keyed import NO_TIME, Ordered, unpacked

MINUTE = 60_000_000


def frame(columns: list[str], **values) -> pd.DataFrame:
    """A result with all ``columns``; those not given are null."""
    values = {c: v.to_numpy() if isinstance(v, pd.Series) else v for c, v in values.items()}
    n = max(len(v) for v in values.values() if isinstance(v, np.ndarray))
    return pd.DataFrame({c: values.get(c, np.full(n, None, object)) for c in columns}, index=range(n))


# Rules

RULE_COLUMNS = {"at_us": "<i8", "signal_id": "<i8", "is_error": "?", "duration_ms": "<f8"}
RULE_RESULT = "tenant_id string, service_name string, output string, at long, signal_id long, is_error boolean, duration_ms double, count long, total long"
_RULE_NAMES = [c.split()[0] for c in RULE_RESULT.split(", ")]


def rule_edges(rows: pd.DataFrame, minutes: dict[int, tuple], firing: tuple[bool, bool], width: int, needed: int, slow_ms: float):
    """Rising edges of both rules in ordered rows of a key, given its earlier ``minutes`` (rows, errors, peak).

    Returns (error edges, rows and errors in the window of each, latency edges, state at the end).
    """
    minute = rows["at_us"].to_numpy() // MINUTE
    error = rows["is_error"].to_numpy().astype(np.int64)
    known = np.array(sorted(minutes), np.int64)
    old = np.array([minutes[m][:2] for m in known.tolist()], np.int64).reshape(-1, 2)

    def in_window(values: np.ndarray, before: np.ndarray) -> np.ndarray:
        sums, upto = np.concatenate([[0], np.cumsum(before)]), np.concatenate([[0], np.cumsum(values)])
        gone = sums[np.searchsorted(known, minute - width, "right")] + upto[np.searchsorted(minute, minute - width, "right")]
        return sums[-1] + upto[1:] - gone

    errors, total = in_window(error, old[:, 1]), in_window(np.ones(len(rows), np.int64), old[:, 0])
    breach = errors >= needed
    edges = np.flatnonzero(breach & ~np.concatenate([[firing[0]], breach[:-1]]))

    took = rows["duration_ms"].to_numpy()
    measured = np.flatnonzero(~np.isnan(took))
    never = np.int64(-(1 << 62))
    before = max((m for m in known.tolist() if minutes[m][2] is not None and minutes[m][2] >= slow_ms), default=never)
    last_slow = np.maximum.accumulate(np.concatenate([[before], np.where(took[measured] >= slow_ms, minute[measured], never)]))[1:]
    slow = last_slow > minute[measured] - width
    slow_edges = measured[slow & ~np.concatenate([[firing[1]], slow[:-1]])]
    after = bool(breach[-1]) if len(breach) else firing[0], bool(slow[-1]) if len(slow) else firing[1]
    return edges, errors[edges], total[edges], slow_edges, after


class Rules(StatefulProcessor):
    """Both rules of a service: its last minutes and whether each rule fires."""

    def __init__(self, order: Ordered, width: int, needed: int, slow_ms: float):
        self.order, self.width, self.needed, self.slow_ms = order, width, needed, slow_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order.open(handle)
        self.minutes = handle.getMapState("minutes", "minute long", "rows long, errors long, peak double", self.order.ttl)
        self.firing = handle.getValueState("firing", "errors boolean, latency boolean", self.order.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ready, late = self.order.pass_on(unpacked(rows, RULE_COLUMNS))
        named = dict(tenant_id=key[0], service_name=key[1])
        if len(late):
            yield frame(_RULE_NAMES, **named, output="late", at=late["at_us"], **{c: late[c] for c in RULE_COLUMNS if c != "at_us"})
        if not len(ready):
            return
        minutes = {k[0]: tuple(v) for k, v in self.minutes.iterator()}
        firing = tuple(self.firing.get()) if self.firing.exists() else (False, False)
        edges, count, total, slow, after = rule_edges(ready, minutes, firing, self.width, self.needed, self.slow_ms)
        for name, at, more in (("high_error_rate", edges, dict(count=count, total=total)), ("high_latency", slow, {})):
            found = ready.iloc[at].reset_index(drop=True)
            if len(found):
                more["duration_ms"] = found["duration_ms"].to_numpy()
                yield frame(_RULE_NAMES, **named, output=name, at=found["at_us"].to_numpy(), signal_id=found["signal_id"].to_numpy(), **more)
        self.firing.update(after)
        here = ready.assign(m=ready["at_us"] // MINUTE).groupby("m").agg(n=("is_error", "size"), e=("is_error", "sum"), p=("duration_ms", "max"))
        newest = int(here.index.max())
        for m, n, e, p in here.itertuples():
            if m > newest - self.width:
                was = minutes.get(m, (0, 0, None))
                peak = max((x for x in (was[2], None if np.isnan(p) else float(p)) if x is not None), default=None)
                self.minutes.updateValue((int(m),), (int(was[0] + n), int(was[1] + e), peak))
        for m in minutes:
            if m <= newest - self.width:
                self.minutes.removeKey((m,))


# Burn rates


class Minutes(StatefulProcessor):
    """Good and bad events of an SLO by minute, over its longest window; decides all minutes that new events reach."""

    def __init__(self, windows: list[int], lateness: int, ttl: int | None):
        self.windows, self.lateness, self.ttl = windows, lateness, ttl
        self.kept = max(windows) + lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.minutes = handle.getMapState("minutes", "minute long", "good long, bad long", self.ttl)
        self.clock = handle.getValueState("clock", "newest long, revision long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = pd.concat(list(rows)).groupby("minute", as_index=False)[["good", "bad"]].sum()
        newest, revision = self.clock.get() if self.clock.exists() else (NO_TIME + 1, 0)
        late = counts["minute"] < max(newest - self.lateness, NO_TIME + 1)
        names = ["slo", "output", "minute", "revision", *(f"{c}_{w}" for w in self.windows for c in ("good", "bad")), "good", "bad"]
        if late.any():
            out = counts[late]
            yield frame(names, slo=key[0], output="late", minute=out["minute"], good=out["good"], bad=out["bad"])
        counts = counts[~late]
        if not len(counts):
            return
        minutes = {k[0]: tuple(v) for k, v in self.minutes.iterator()}
        for m, good, bad in counts.itertuples(index=False):
            was = minutes.get(int(m), (0, 0))
            minutes[int(m)] = int(was[0] + good), int(was[1] + bad)
            self.minutes.updateValue((int(m),), minutes[int(m)])
        newest = max(newest, int(counts["minute"].max()))
        known = np.array(sorted(minutes), np.int64)
        sums = np.concatenate([[[0, 0]], np.cumsum([minutes[m] for m in known.tolist()], axis=0)])
        decided = known[known >= counts["minute"].min()]
        values = {}
        for w in self.windows:
            inside = sums[np.searchsorted(known, decided, "right")] - sums[np.searchsorted(known, decided - w, "right")]
            values |= {f"good_{w}": inside[:, 0], f"bad_{w}": inside[:, 1]}
        yield frame(names, slo=key[0], output="decisions", minute=decided, revision=revision + 1, **values)
        self.clock.update((newest, revision + 1))
        for m in known[known <= newest - self.kept].tolist():
            self.minutes.removeKey((m,))


# Baselines

SAMPLE_COLUMNS = {"at_us": "<i8", "signal_id": "<i8", "value": "<f8"}


class Baseline(StatefulProcessor):
    """Mean, variance and count of a series, folded over its samples in order."""

    def __init__(self, order: Ordered, alpha: float):
        self.order, self.alpha = order, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order.open(handle)
        self.state = handle.getValueState("baseline", "mean double, var double, n long", self.order.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ready, late = self.order.pass_on(unpacked(rows, SAMPLE_COLUMNS))
        names = ["tenant_id", "metric_name", "output", "at", "signal_id", "value", "mean", "var", "n"]
        for output, found in (("late", late), ("scores", ready)):
            if len(found):
                state = {}
                if output == "scores":
                    before = tuple(self.state.get()) if self.state.exists() else None
                    mean, var, n = fold_on(found["value"].to_numpy(), before, self.alpha)
                    self.state.update((float(mean[-1]), float(var[-1]), int(n[-1])))
                    state = dict(mean=mean, var=var, n=n)
                own = {c: found[c].to_numpy() for c in ("signal_id", "value")}
                yield frame(names, tenant_id=key[0], metric_name=key[1], output=output, at=found["at_us"].to_numpy(), **own, **state)


# Sampling. Rows that a step has nothing to do with come under keys of their own, spread by hash.

ASIDE = "-"


class ServiceBaseline(StatefulProcessor):
    """The latency baseline of a service before each of its spans, in the order in which micro-batches bring them."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", "mean double, var double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[1].startswith(ASIDE):
            for part in rows:
                yield part.assign(mean0=np.nan, var0=np.nan, n0=0)
            return
        own = pd.concat(list(rows)).sort_values(["at_us", "signal_id"], kind="stable", ignore_index=True)
        before = tuple(self.state.get()) if self.state.exists() else None
        mean, var, n = fold_on(own["duration_ms"].to_numpy(dtype="float64"), before, self.alpha)
        self.state.update((float(mean[-1]), float(var[-1]), int(n[-1])))
        first = before or (np.nan, np.nan, 0)
        shifted = [np.concatenate([[a], b[:-1]]) for a, b in zip(first, (mean, var, n))]
        yield own.assign(mean0=shifted[0], var0=shifted[1], n0=shifted[2].astype(np.int64))


class TraceRecency(StatefulProcessor):
    """Whether a trace was not seen within ``recent`` of each of its spans, for the traces of one hash bucket of a tenant.

    Sightings that lie ``remembered`` before what two micro-batches in a row brought are forgotten: by the middle of their times,
    so a few spans of a fast clock forget nothing.
    """

    def __init__(self, recent: int, remembered: int):
        self.recent, self.remembered = recent, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "trace string", "at long")
        self.clock = handle.getValueState("clock", "middle long, swept long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[1].startswith(ASIDE):
            for part in rows:
                yield part.assign(unseen=False)
            return
        own = pd.concat(list(rows)).sort_values(["trace_id", "at_us", "signal_id"], kind="stable", ignore_index=True)
        first = np.flatnonzero(own["trace_id"] != own["trace_id"].shift())
        at, before = own["at_us"].to_numpy(), []
        for trace, times in zip(own["trace_id"].iloc[first], np.split(at, first[1:])):
            last = self.seen.getValue((trace,))[0] if self.seen.containsKey((trace,)) else NO_TIME
            # A span that comes late is near what was seen after it, too.
            upto = np.maximum.accumulate(np.concatenate([[last], times]))
            self.seen.updateValue((trace,), (int(upto[-1]),))
            before.append(upto[:-1])
        before = np.concatenate(before)
        yield own.assign(unseen=(before == NO_TIME) | (np.abs(at - before) >= self.recent))
        middle = int(np.median(at))
        known, swept = self.clock.get() if self.clock.exists() else (middle, middle)
        horizon = min(known, middle)
        if horizon >= swept + self.remembered:
            for trace in [k[0] for k, v in self.seen.iterator() if v[0] < horizon - self.remembered]:
                self.seen.removeKey((trace,))
            swept = horizon
        self.clock.update((middle, swept))


class Queue(StatefulProcessor):
    """A tenant's queue of traces until it is full, and from then on only the place at which it was."""

    def __init__(self, limit: int, keep_score: float):
        self.limit, self.keep_score = limit, keep_score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.traces = handle.getMapState("traces", "trace string", "at long")
        self.full = handle.getValueState("full", "at long, signal_id long, queued long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[1].startswith(ASIDE):
            for part in rows:
                yield part.assign(keep=True)
            return
        own = pd.concat(list(rows)).sort_values(["at_us", "signal_id"], kind="stable", ignore_index=True)
        at, signal_id, queued = self.full.get() if self.full.exists() else (None, None, 0)
        if at is None:
            known = {k[0] for k in self.traces.keys()}
            for trace, t, i in zip(own["trace_id"], own["at_us"].tolist(), own["signal_id"].tolist()):
                if trace in known:
                    continue
                if queued == self.limit:
                    at, signal_id = t, i
                    self.traces.clear()
                    break
                known.add(trace)
                self.traces.updateValue((trace,), (t,))
                queued += 1
            self.full.update((at, signal_id, queued))
        within = np.ones(len(own), bool)
        if at is not None:
            within = (own["at_us"] < at) | ((own["at_us"] == at) & (own["signal_id"] < signal_id))
        yield own.assign(keep=within | (own["score"] >= self.keep_score))


# Alerts


def counted_votes(rows: pd.DataFrame) -> pd.DataFrame:
    """The events among ``rows``, hushed too where a vote for the same time and texts says so."""
    vote = rows["vote"].to_numpy(dtype=bool)
    events = rows[~vote].drop(columns="vote")
    if vote.any():
        at, texts = rows["at_us"], rows["texts"]
        hushed = set(zip(at[vote], texts[vote]))
        events["hushed"] |= np.fromiter((k in hushed for k in zip(events["at_us"], events["texts"])), bool, len(events))
    return events.reset_index(drop=True)


class Alert(StatefulProcessor):
    """The row of one alert, changed by its events in order."""

    def __init__(self, order: Ordered):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order.open(handle)
        self.alert = handle.getValueState("alert", "row string", self.order.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ready, late = self.order.pass_on(counted_votes(pd.concat(list(rows), ignore_index=True)))
        own = json.loads(self.alert.get()[0]) if self.alert.exists() else {"revision": 0}
        outputs, moved = ["late"] * len(late), False
        events = [*late.itertuples(index=False)]
        for event in ready.itertuples(index=False):
            firing = own.get("state") == "firing"
            at = int(event[ready.columns.get_loc("at_us")])
            if event.resolved:
                if firing:
                    own |= {"state": "resolved", "resolved_at": max(at, own.get("resolved_at") or at)}
                    moved = True
                outputs.append("alert.resolved")
                events.append(event)
                continue
            if not firing:
                own |= {"state": "firing", "texts": event.texts, "starts_at": at, "resolved_at": None}
                if not event.hushed:
                    own |= {"notified_at": at, "notify_count": own.get("notify_count", 0) + 1}
                    outputs.append("alert.fired")
                    events.append(event)
            own["last_seen_at"] = at
            moved = True
        if events:
            found = pd.DataFrame(events, columns=ready.columns if len(ready) else late.columns)
            yield pd.DataFrame({"fingerprint": key[0], "output": outputs, "row": found["whole"], "revision": 0})
        if moved:
            own["revision"] += 1
            self.alert.update((json.dumps(own),))
            row = {k: v for k, v in own.items() if k != "revision"}
            yield pd.DataFrame({"fingerprint": [key[0]], "output": "alerts", "row": [json.dumps(row)], "revision": [own["revision"]]})
