"""Token ids packed into rows of fixed length, best fit decreasing.

Documents are encoded and cut into pieces of at most the row length, losslessly; an encoded block's
pieces are packed longest first into the fullest row that still has room. That row is found by a segment
tree over free capacities: a node tells whether any row below it has that much room, so the least
sufficient capacity is found in as many steps as the tree has levels.

A row is a binary of little-endian 16-bit ids, padded; beside it are the cumulative lengths of its
segments, the places at which positions restart, and where each segment comes from.

Blocks are bounded in tokens and packed by the task that encoded them; the last row or two of a block stay
partly empty. Null and empty texts have no piece. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.bpe import BLOCK_CHARS, cut, rank_file
from signalmill.llm.common import narrow

#: Ids in a row, and ids in a block that is packed at once.
ROW_IDS, BLOCK_IDS = 2048, 1 << 22


class CapacityTree:
    """Rows by free capacity 0..size, with a segment tree over the capacities that have any."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row of the smallest capacity from ``least`` on, and that capacity; it is taken out."""
        node = self.leaves + least
        while not self.count[node]:
            while node & 1:  # a right child: what is greater lies beyond its parent
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Pieces of each row, by index; longest first, ties in their order."""
    rows: list[list[int]] = []
    free = CapacityTree(size)
    sizes = lengths.tolist()
    for piece in np.argsort(-lengths, kind="stable").tolist():
        found = free.take(sizes[piece])
        if found is None:
            row, room = len(rows), size
            rows.append([])
        else:
            row, room = found
        rows[row].append(piece)
        if room > sizes[piece]:
            free.add(room - sizes[piece], row)
    return rows


class Packer:
    """Pieces of the documents of a block, and the rows they make."""

    def __init__(self, size: int, pad: int):
        self.size, self.pad = size, pad
        self.clear()

    def clear(self) -> None:
        self.pieces, self.keys, self.starts, self.ids = [], [], [], 0

    def add(self, key, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.size):
            self.pieces.append(ids[at : at + self.size])
            self.keys.append(key)
            self.starts.append(at)
        self.ids += len(ids)

    def packed(self) -> Iterator[tuple]:
        for row in best_fit_decreasing(np.array([len(p) for p in self.pieces], np.int64), self.size):
            own = [self.pieces[i] for i in row]
            ends = np.cumsum([len(p) for p in own]).tolist()
            flat = np.full(self.size, self.pad, "<u2")
            flat[: ends[-1]] = np.concatenate(own)
            resets = [0, *ends] if ends[-1] < self.size else [0, *ends[:-1]]
            yield (
                flat.tobytes(), ends[-1], [0, *ends], resets, [self.keys[i] for i in row], [self.starts[i] for i in row],
            )


def pack(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", row_ids: int = ROW_IDS,
    block_ids: int = BLOCK_IDS, pad: int | None = None,
) -> DataFrame:
    """Packed rows of all texts.

    Returns ``input_ids`` (binary), ``n_ids`` (without padding), ``cu_seqlens`` (from 0, each segment's
    end), ``position_resets`` (first places of the segments and of the padding), ``doc_keys`` and
    ``doc_starts`` (each segment's document and its first id there). ``pad`` is by default the first free id.
    """
    docs = narrow(docs, key, text)
    data = rank_file(path)
    sent = docs.sparkSession.sparkContext.broadcast(data)  # a vocabulary: rank_file checks its size
    schema = T.StructType(
        [T.StructField("input_ids", T.BinaryType()), T.StructField("n_ids", T.IntegerType()),
         T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_resets", T.ArrayType(T.IntegerType())),
         T.StructField("doc_keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("doc_starts", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in sent.value.splitlines() if line.strip())}
        free = max(ranks.values()) + 1
        if max(free, pad or 0) >= 1 << 16:
            raise ValueError("ids are written in 16 bits")
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        packer = Packer(row_ids, free if pad is None else pad)

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = list(packer.packed())
            packer.clear()
            for at in range(0, len(rows), 4096):
                columns = list(zip(*rows[at : at + 4096]))
                kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), None, pa.list_(pa.int64())]
                kinds[4] = pa.list_(key_kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            key_kind = batch.schema.types[0]
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value:
                    continue
                parts = cut(value) if len(value) > BLOCK_CHARS else [value]
                found = [np.asarray(encoding.encode_to_numpy(p, disallowed_special=())).astype("<u2") for p in parts]
                packer.add(own, found[0] if len(found) == 1 else np.concatenate(found))
                if packer.ids >= block_ids:
                    yield from flushed()
        if packer.ids:
            yield from flushed()

    return docs.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """Packed rows with their ids as a digest."""
    return rows.select(
        "n_ids", "cu_seqlens", "position_resets", F.col("doc_keys").alias("doc_ids"), "doc_starts",
        F.sha2("input_ids", 256).alias("ids_sha256"),
    )
