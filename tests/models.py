"""Plain Python models of the stateful algorithms, one row at a time."""

from __future__ import annotations

from collections import defaultdict

MINUTE = 60


def sliding_counts(rows, minutes):
    """rows: (key, second, id, flag) -> id: flagged rows in the minute buckets up to the row."""
    seen, out = defaultdict(list), {}
    for key, second, rid, flag in sorted(rows, key=lambda r: (r[1], r[2])):
        now = second // MINUTE
        seen[key].append((now, flag))
        out[rid] = sum(f for m, f in seen[key] if now - minutes < m <= now)
    return out


def error_edges(rows, minutes, threshold):
    """Ids at which the error rate starts to reach the threshold, with (rate, ratio, total)."""
    errors, totals, firing, out = defaultdict(list), defaultdict(list), defaultdict(bool), {}
    span = minutes * MINUTE
    for key, second, rid, flag in sorted(rows, key=lambda r: (r[1], r[2])):
        now = second // MINUTE
        totals[key].append(now)
        if flag:
            errors[key].append(now)
        bad = sum(now - minutes < m <= now for m in errors[key]) / span
        total = sum(now - minutes < m <= now for m in totals[key]) / span
        if bad >= threshold:
            if not firing[key]:
                out[rid] = (bad, bad / total, total)
            firing[key] = True
        else:
            firing[key] = False
    return out


def latency_edges(rows, minutes, threshold):
    """rows: (key, second, id, ms) -> id: peak at which the latency rule fires."""
    seen, firing, out = defaultdict(list), defaultdict(bool), {}
    for key, second, rid, ms in sorted(rows, key=lambda r: (r[1], r[2])):
        now = second // MINUTE
        seen[key].append((now, ms))
        peak = max([v for m, v in seen[key] if now - minutes < m <= now] + [0.0])
        if peak >= threshold:
            if not firing[key]:
                out[rid] = peak
            firing[key] = True
        else:
            firing[key] = False
    return out


def ewma(values, alpha, state=None):
    """(mean, var, n) before and after each value."""
    out = []
    mean, var, n = state or (None, 0.0, 0)
    for x in values:
        before = (mean, var, n)
        if n == 0:
            mean = x
        else:
            d = x - mean
            mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
        n += 1
        out.append((before, (mean, var, n)))
    return out


def sampler(rows, rate, max_size, recent):
    """rows: (trace, second, id, score) of one tenant, in order -> id: keep."""
    queue, last, out = {}, {}, {}
    limit = max(1, int(max_size * rate))
    for clock, (trace, second, rid, score) in enumerate(rows):
        before = last.get(trace)
        queue[trace] = (score, clock)
        last[trace] = second
        while len(queue) > max_size:
            queue.pop(min(queue, key=queue.get))
        out[rid] = score >= 50 or (before is not None and second - before < recent) or len(queue) <= limit
    return out


def alert_table(events):
    """events: (id, key, resolved) in order -> steps by id and final (state, starts, last, ended) by key."""
    table, steps = {}, {}
    for rid, key, resolved in events:
        row = table.get(key)
        if resolved:
            if row and row["state"] == "firing":
                row.update(state="resolved", ended=rid)
                steps[rid] = "resolved"
        elif row is None or row["state"] == "resolved":
            table[key] = {"state": "firing", "starts": rid, "last": rid, "ended": None}
            steps[rid] = "created"
        else:
            row["last"] = rid
            steps[rid] = "updated"
    return table, steps


def quantile(values, p):
    values = sorted(values)
    rank = p * (len(values) - 1)
    low, high = values[int(rank)], values[min(int(rank) + 1, len(values) - 1)]
    return low + (high - low) * (rank - int(rank))
