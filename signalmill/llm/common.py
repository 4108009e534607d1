"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled at a time inside a task; longer texts are cut, shorter ones gathered.
BLOCK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has; Spark doesn't tell cases apart."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns: others never reach a Python worker, whatever they are called."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def least_hashes(rows: DataFrame, by: list[str], n: int, count: int) -> DataFrame:
    """About ``n`` or more of ``count`` rows: those whose hash of ``by`` is low, all if there are few.

    A choice of the n least hashes may follow: what each task sends for it no longer grows with the input.
    """
    share = min(1.0, (2 * n + 100) / max(1, count))
    low = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by], F.lit("sample")), F.lit(1 << 30))
    return rows if share == 1.0 else rows.where(low < int(share * (1 << 30)))


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and n + 1 offsets into it; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole, offsets - (offsets[0] if len(offsets) else 0)


def text_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and n + 1 offsets into it; null counts as empty."""
    whole = [t or "" for t in texts]
    points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)


# Hashes of many spans of one array at once, from running sums modulo 2**64

MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x100000001B3  # odd, so that its powers have inverses
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, step: int) -> np.ndarray:
    """The first ``n`` powers; those that a usual block needs are kept."""
    known = _POWERS.get(step)
    if known is None or len(known) < n:
        known = np.ones(max(n, 1 << 16), np.uint64)
        known[1:] = np.uint64(step)
        np.multiply.accumulate(known, out=known)
        if len(known) <= 2 * BLOCK_CHARS:
            _POWERS[step] = known
    return known[:n]


class SpanHash:
    """64-bit hashes of spans [start, end) of an array of small numbers; equal spans have equal hashes."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(len(values), _STEP), out=self.sums[1:])
        self.back = _powers(len(values) + 1, pow(_STEP, -1, 2**64))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * MULT)


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run goes on over a cut."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(inside):
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(inside))])
        split = cuts[inside[cuts] & inside[cuts - 1]]
        if len(split):
            starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes; runs across texts are the caller's to leave out."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * MULT + hashes[k : k + n]
    return mix(out)
