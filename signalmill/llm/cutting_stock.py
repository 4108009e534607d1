"""Packing by cutting-stock column generation.

Documents are encoded and ended by one id. What exceeds a whole number of sequences is a document's tail; the
full pieces before it are sequences of their own. Tails are counted by length in bins, and a linear program
over patterns (how many tails of each bin share a sequence) covers the counts with the fewest sequences. It
starts from one pattern a bin; a knapsack by dynamic programming over the program's prices finds the next
pattern worth adding, until none is. Only the histogram, a bounded table, reaches the driver.

The patterns' amounts are rounded down, a little below the optimum. Tails are ranked within their bin, longest first in
each task's rows, and ranks fall into the patterns' places. The tails left over are cut to fill up what sequences have free; what is left of
them then makes full sequences, and the last ids of a group sequences of lengths that are powers of two, which need no padding.

Null and empty texts have the ending id alone. Repeated rows and keys are packed as often as they occur.
An empty table gives no row. Other columns are not read. Sequence ids are unique but not dense.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.bpe import BLOCK_CHARS, cut, rank_file
from signalmill.llm.common import narrow
from signalmill.sources.tables import written

#: Ids in a sequence, and ids that a bin of the histogram spans.
SEQUENCE, BIN = 2048, 8
#: Rounds of column generation at most; it ends when the program is this close to its bound. Any patterns pack everything.
ROUNDS, NEAR = 5000, 1e-4
#: Ids left over for one free id, and sequences and left-over tails that one task fills up.
SPARE, GROUP_SEQUENCES, GROUP_TAILS = 1.5, 1 << 13, 1 << 18
#: Where the numbers of filled-up and of full sequences begin.
EXTRA, FULL = 1 << 61, 1 << 62


def vocabulary(data: bytes) -> dict[bytes, int]:
    """Ids of a byte-level vocabulary file in JSON by their bytes; an id is also its rank as a merge."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    parsed = json.loads(data)
    special = {t["content"] for t in parsed["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in parsed["model"]["vocab"].items() if t not in special}


_LOADED: dict[tuple[int, str], tiktoken.Encoding] = {}


def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of this worker, built once; it gives the ids of the file's own library, which is several times slower."""
    name = (zlib.crc32(data), pattern)
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=vocabulary(data), special_tokens={})
    return _LOADED[name]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, path: str, pattern: str, key: str, text: str, size: int, end: int) -> DataFrame:
    """Full pieces (``sequence_id``) and tails (``ids``, little-endian of 32 bits) of all texts; a tail is named by (``part``, ``at``)."""
    docs = narrow(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(rank_file(path))  # its size is checked
    kinds = [pa.int32(), pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["part", "at", "key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids"]
    types = [T.IntegerType(), T.LongType(), docs.schema[key].dataType, *[T.LongType()] * 5, T.BinaryType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part = _encoding(sent.value, pattern), TaskContext.get().partitionId()
        rows, at, fulls = [], 0, 0
        for batch in batches:
            kinds[2] = batch.schema.types[0]
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = cut(value) if value and len(value) > BLOCK_CHARS else [value or ""]
                ids = np.concatenate([*(encoding.encode_to_numpy(p, disallowed_special=()) for p in parts), [end]]).astype("<u4")
                for start in range(0, len(ids) - size + 1, size):
                    number = FULL + (part << 36) + fulls
                    rows.append((part, at, own, start, size, crc32(ids[start : start + size]), len(ids), number, None))
                    fulls += 1
                rest = len(ids) % size
                if rest:
                    tail = ids[-rest:]
                    rows.append((part, at, own, len(ids) - rest, rest, crc32(tail), len(ids), None, tail.astype("<u4").tobytes()))
                at += 1
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))


# Patterns


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest price: value of an unbounded knapsack by dynamic programming, and counts by size."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")  # sizes ascend
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fitting[room]
        if n:
            values = best[room - sizes[:n]] + prices[:n]
            i = int(values.argmax())
            if values[i] > best[room]:
                best[room], chosen[room] = values[i], i
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            counts[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(best[capacity]), counts


def cover(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row, counts by size) and how often each is used, so that the counts of all sizes are covered.

    Column generation for the linear program: sizes ascend, every demand is above 0.
    """
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(np.float64))
    costs, inverse = np.ones(m), np.diag(1 / np.diag(columns))
    amounts = inverse @ demand
    for done in range(rounds):
        prices = costs @ inverse
        low = int(prices.argmin())
        if prices[low] < -1e-9:  # covering less of this size is worth it
            column, cost = -np.eye(m)[low], 0.0
        else:
            value, column = best_pattern(np.maximum(prices, 0), sizes, capacity)
            cost = 1.0
            if value <= 1 + 1e-9 or costs @ amounts <= (demand @ prices) / value * (1 + NEAR):
                break
        toward = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(amounts, toward, out=ratio, where=toward > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amounts = amounts - ratio[out] * toward
        amounts[out] = ratio[out]
        columns[:, out], costs[out] = column, cost
        if done % 64 == 63:
            inverse = np.linalg.inv(columns)
            amounts = inverse @ demand
        else:
            row = inverse[out] / toward[out]
            inverse = inverse - np.outer(toward, row)
            inverse[out] = row
    used = costs > 0
    return columns.T[used].round().astype(np.int64), np.maximum(amounts[used], 0)


class Places:
    """Which sequence and place the tail of a bin gets by its rank: rounded patterns, numbered in turn."""

    def __init__(self, counts: dict[int, int], size: int, width: int):
        """``counts`` by length of tail."""
        by_bin: dict[int, int] = {}
        for length, n in counts.items():
            by_bin[-(-length // width)] = by_bin.get(-(-length // width), 0) + n
        self.bins: dict[int, tuple[np.ndarray, ...]] = {}
        self.sequences = 0
        if not by_bin:
            return
        sizes = np.array(sorted(by_bin), np.int64)
        demand = np.array([by_bin[s] for s in sizes.tolist()], np.float64)
        patterns, amounts = cover(sizes, demand, size // width)
        ids = sum(length * n for length, n in counts.items())
        free = max(0.0, SPARE * (amounts.sum() * size - ids))
        times = np.floor(amounts * ids / (ids + free) + 1e-9).astype(np.int64)
        first = np.cumsum(times) - times
        self.sequences = int(times.sum())
        # Longest first within a sequence.
        before = np.cumsum(patterns[:, ::-1], axis=1)[:, ::-1] - patterns
        for i, s in enumerate(sizes.tolist()):
            own = np.flatnonzero((patterns[:, i] > 0) & (times > 0))
            ends = np.cumsum(patterns[own, i] * times[own])
            self.bins[s] = (ends, patterns[own, i], first[own], before[own, i])

    def of(self, bins: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence (-1: left over) and place within it."""
        sequence, place = np.full(len(bins), -1, np.int64), np.zeros(len(bins), np.int64)
        for s in np.unique(bins).tolist():
            ends, each, first, before = self.bins[s]
            rows = np.flatnonzero(bins == s)
            at = np.searchsorted(ends, ranks[rows], side="right")
            rows, at = rows[at < len(ends)], at[at < len(ends)]
            inside = ranks[rows] - np.concatenate([[0], ends])[at]
            sequence[rows] = first[at] + inside // each[at]
            place[rows] = before[at] + inside % each[at]
        return sequence, place


def fill(free: np.ndarray, tails: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Cut tails, in turn, into free rooms: (tail, start there, length, room, start there), and the sizes of more rooms for the rest.

    The rest makes rooms of ``size``, and of powers of two that add up to what remains.
    """
    rest = max(0, int(tails.sum() - free.sum()))
    last = rest % size
    more = [size] * (rest // size) + [1 << b for b in range(last.bit_length() - 1, -1, -1) if last >> b & 1]
    rooms = np.concatenate([free, np.array(more, np.int64)])
    room_ends, tail_ends = np.cumsum(rooms), np.cumsum(tails)
    ends = np.unique(np.concatenate([room_ends, tail_ends]))
    ends = ends[(ends > 0) & (ends <= tail_ends[-1])] if len(tails) else ends[:0]
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    tail, room = np.searchsorted(tail_ends, starts, side="right"), np.searchsorted(room_ends, starts, side="right")
    return tail, starts - (tail_ends - tails)[tail], ends - starts, room, starts - (room_ends - rooms)[room], np.array(more, np.int64)


def _ranked(tails: DataFrame) -> DataFrame:
    """``rank`` from 0 within the bin: counts by task and bin give a task's first rank, so a common length is ranked by many tasks."""
    counted = tails.groupBy("bin", "part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("bin", "part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("bin", "part").orderBy(F.desc("length"), "at"))
    return tails.withColumn("_in", inside).join(before, ["bin", "part"]).withColumn("rank", F.col("_before") + F.col("_in") - 1)


def pack(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, width: int = BIN,
    end: int = 1,
) -> DataFrame:
    """Where every id of every text lies, one row a piece.

    Returns ``key``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``
    and ``offset`` there. ``width`` divides ``size``. A document's ids end with ``end``.
    """
    rows = written(encoded(docs, path, pattern, key, text, size, end), "encoded")
    out = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = rows.where(F.col("ids").isNull()).withColumn("offset", F.lit(0).cast("long")).select(*out)
    tails = rows.where(F.col("ids").isNotNull()).drop("ids", "sequence_id")
    # At most one row for each length below the sequence's.
    counts = {r["length"]: r["count"] for r in tails.groupBy("length").count().collect()}
    places = Places(counts, size, width)
    ranked = _ranked(tails.withColumn("bin", F.ceil(F.col("length") / width).cast("long")))
    schema = T.StructType([f for f in ranked.schema.fields if f.name not in ("_in", "_before", "bin", "rank")])
    names = [f.name for f in schema.fields]
    schema = schema.add("sequence_id", T.LongType()).add("place", T.LongType())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, place = places.of(*(batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("bin", "rank")))
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(place)], names=schema.names)

    slots = written(ranked.mapInArrow(placed, schema), "slots")
    kept = slots.where("sequence_id >= 0")
    upto = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = kept.withColumn("offset", F.sum("length").over(upto) - F.col("length")).select(*out)
    return full.unionByName(whole).unionByName(_filled(slots, rows, places.sequences, size).select(*out)).withColumnRenamed("key", key)


def _filled(slots: DataFrame, rows: DataFrame, sequences: int, size: int) -> DataFrame:
    """Pieces of the tails left over: cut to fill what sequences have free, then to sequences of their own."""
    left = slots.where("sequence_id < 0").select("part", "at", "length")
    groups = max(1, -(-sequences // GROUP_SEQUENCES), -(-left.count() // GROUP_TAILS))
    used = slots.where("sequence_id >= 0").groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < size)
    each = max(1, -(-sequences // groups))
    used = used.withColumn("group", F.floor(F.col("sequence_id") / each))
    dealt = left.withColumn("group", F.pmod(F.xxhash64("part", "at"), F.lit(groups)))

    def run(rooms: pd.DataFrame, tails: pd.DataFrame) -> pd.DataFrame:
        rooms, tails = rooms.sort_values("sequence_id"), tails.sort_values(["part", "at"])
        tail, inside, length, room, offset, more = fill((size - rooms["used"]).to_numpy(np.int64), tails["length"].to_numpy(np.int64), size)
        group = int(tails["group"].iloc[0]) if len(tails) else 0
        ids = np.concatenate([rooms["sequence_id"].to_numpy(np.int64), EXTRA + (group << 36) + np.arange(len(more))])
        first = np.concatenate([rooms["used"].to_numpy(np.int64), np.zeros(len(more), np.int64)])
        return pd.DataFrame({
            "part": tails["part"].to_numpy(np.int32)[tail], "at": tails["at"].to_numpy(np.int64)[tail], "inside": inside, "piece": length,
            "sequence_id": ids[room], "offset": first[room] + offset,
        })

    cuts = used.groupBy("group").cogroup(dealt.groupBy("group")).applyInPandas(
        run, "part int, at long, inside long, piece long, sequence_id long, offset long"
    )
    pieces = rows.where(F.col("ids").isNotNull()).drop("sequence_id").join(cuts, ["part", "at"])
    bytes_of = F.substring("ids", F.col("inside") * 4 + 1, F.col("piece") * 4)
    return pieces.select(
        "key", (F.col("start") + F.col("inside")).alias("start"), F.col("piece").alias("length"), F.crc32(bytes_of).alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
