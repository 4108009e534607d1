"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are computed from whole texts in Arrow batches. Distinct ones are the keys of a binary
trie, which is cut into nodes of bounded size. Two nodes meet in a task when their prefixes are within
the error budget; there both subtrees are walked together, level by level: a pair of children inherits
the differing bits of its parents, one more where their bits differ, and is dropped once the budget is
exceeded. Pairs of leaves that are left are links. A task gives a spanning forest of its links, so a
dense group costs its size, not its square. Components are found by rounds of joins.

Nulls in the text count as an empty one (fingerprint zero). Null ids are kept; a component whose ids
are all null has a null id. Repeated rows are documents like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.common import narrow, unused
from signalmill.operators.skew import checked_broadcast
from signalmill.session import reliable
from signalmill.sources.tables import written

BITS = 64
#: Fingerprints of a trie node that one task may hold, twice; bits of the shortest and longest node prefix.
NODE_ROWS, LEAST_DEPTH, MOST_DEPTH = 1 << 17, 4, 14
#: Shingles hashed at a time, and pairs of nodes walked at a time.
HASH_BLOCK, PAIR_BLOCK = 1 << 16, 1 << 18
#: Two nodes with so few pairs of keys are compared key by key.
SMALL = 4


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles of the whole text; bit set if in over half the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64)) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASH_BLOCK):
        spans = zip(starts[at : at + HASH_BLOCK].tolist(), ends[at : at + HASH_BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``key`` and ``fp`` (a signed long of the 64 bits) of every row."""
    docs = narrow(docs, key, text)
    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


# The trie inside a task


class Trie:
    """Levels of the binary trie of sorted distinct keys: each node's first key, size and two children (-1: none)."""

    def __init__(self, keys: np.ndarray, least_depth: int = 0):
        self.keys, self.levels = keys, []
        start = np.zeros(min(1, len(keys)), np.int64)
        for depth in range(BITS + 1):
            size = np.diff(start, append=len(keys))
            if depth == BITS or not len(size) or (depth >= least_depth and size.max() == 1):
                none = np.full(len(start), -1, np.int32)
                self.levels.append((start.astype(np.int32), size.astype(np.int32), none, none))
                break
            bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones = np.add.reduceat(bit.astype(np.int64), start)
            zeros, parts = size - ones, (ones > 0).astype(np.int32) + (ones < size)
            first = np.cumsum(parts) - parts
            left = np.where(zeros > 0, first, -1).astype(np.int32)
            right = np.where(ones > 0, first + (zeros > 0), -1).astype(np.int32)
            self.levels.append((start.astype(np.int32), size.astype(np.int32), left, right))
            below = np.empty(int(parts.sum()), np.int64)
            below[left[left >= 0]] = start[left >= 0]
            below[right[right >= 0]] = (start + zeros)[right >= 0]
            start = below


def tries(a: np.ndarray, b: np.ndarray) -> tuple[Trie, Trie]:
    """Tries of two sets of keys with equally many levels."""
    x = Trie(a)
    y = Trie(b, len(x.levels) - 1)
    return (Trie(a, len(y.levels) - 1) if len(y.levels) > len(x.levels) else x), y


def linked_leaves(a: Trie, b: Trie, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys within ``budget`` bits; with ``a is b`` each pair once and none with itself.

    Both need levels down to single keys, as :func:`tries` makes them. Blocks of node pairs wait on a stack, so memory stays bounded. Pairs that hold few keys are compared.
    """
    same = a is b
    if not len(a.keys) or not len(b.keys):
        return
    none = np.zeros(1, np.int32)
    stack = [(0, none, none, np.zeros(1, np.int8))]
    last = min(len(a.levels), len(b.levels)) - 1
    while stack:
        depth, i, j, err = stack.pop()
        if not len(i):
            continue
        if len(i) > PAIR_BLOCK:
            half = len(i) // 2
            stack += [(depth, i[half:], j[half:], err[half:]), (depth, i[:half], j[:half], err[:half])]
            continue
        a_start, a_size, a_left, a_right = a.levels[depth]
        b_start, b_size, b_left, b_right = b.levels[depth]
        wa, wb = a_size[i], b_size[j]
        each = wa.astype(np.int64) * wb
        small = each <= SMALL if depth < last else np.ones(len(i), bool)
        at = np.flatnonzero(small)
        if at.size:
            x, y = a_start[i[at]], b_start[j[at]]
            wide = np.flatnonzero(each[at] > 1)
            alone = each[at] == 1
            parts = [(x[alone], y[alone])]
            if wide.size:
                n, width = each[at][wide], wb[at][wide]
                own = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                parts.append((x[wide][own] + k // width[own], y[wide][own] + k % width[own]))
            for x, y in parts:
                near = np.bitwise_count(a.keys[x] ^ b.keys[y]) <= budget
                if same:
                    near &= x < y
                if near.any():
                    yield x[near], y[near]
            if at.size == len(i):
                continue
            i, j, err = i[~small], j[~small], err[~small]
        al, ar, bl, br = a_left[i], a_right[i], b_left[j], b_right[j]
        room = err < budget
        kept = []
        for x, y, more in ((al, bl, 0), (ar, br, 0), (al, br, 1), (ar, bl, 1)):
            ok = (x >= 0) & (y >= 0)
            if more:
                ok &= room
            if same:
                ok &= x <= y  # the mirror image of a pair is walked once
            ok = np.flatnonzero(ok)
            kept.append((x[ok], y[ok], err[ok] + np.int8(more)))
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*kept))))


def forest(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Least member of each node's component, by repeated hooking of roots and halving of paths."""
    root = np.arange(n)
    for x, y in links:
        while True:
            rx, ry = root[x], root[y]
            differ = rx != ry
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(root, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def node_links(left: np.ndarray, right: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of two nodes' sorted keys, or of one: (least key, other key)."""
    if right is None:
        keys, trie = left, Trie(left)
        root = forest(linked_leaves(trie, trie, budget), len(left))
    else:
        keys = np.concatenate([left, right])
        pairs = ((x, y + len(left)) for x, y in linked_leaves(*tries(left, right), budget))
        root = forest(pairs, len(keys))
    others = np.flatnonzero(root != np.arange(len(keys)))
    return keys[root[others]], keys[others]


# The trie across tasks


def trie_nodes(counts: dict[int, int], node_rows: int = NODE_ROWS) -> list[tuple[int, int, int]]:
    """(prefix, depth, pages) of the nodes that a trie is cut into; ``counts`` by prefix of MOST_DEPTH bits.

    A node is cut while it has more than ``node_rows`` keys; at MOST_DEPTH the rest is dealt over pages.
    """
    level = {}
    for prefix, n in counts.items():
        level[prefix] = n
    sums = {MOST_DEPTH: level}
    for depth in range(MOST_DEPTH - 1, -1, -1):
        above: dict[int, int] = {}
        for prefix, n in sums[depth + 1].items():
            above[prefix >> 1] = above.get(prefix >> 1, 0) + n
        sums[depth] = above
    out, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        n = sums[depth].get(prefix, 0)
        if not n:
            continue
        if depth < LEAST_DEPTH or (n > node_rows and depth < MOST_DEPTH):
            todo += [(prefix << 1, depth + 1), (prefix << 1 | 1, depth + 1)]
        else:
            out.append((prefix, depth, -(-n // node_rows)))
    return sorted(out, key=lambda x: x[0] << (MOST_DEPTH - x[1]))


def near_nodes(nodes: list[tuple[int, int, int]], budget: int):
    """For a node's index, the indexes from itself on whose prefixes are within the budget on their common bits."""
    prefix, depth = (np.array([n[i] for n in nodes], np.int64) for i in (0, 1))
    wide = prefix << (MOST_DEPTH - depth)

    def of(i: int) -> np.ndarray:
        common = np.minimum(depth[i:], depth[i])
        differ = np.bitwise_count((wide[i:] ^ wide[i]) >> (MOST_DEPTH - common))
        return np.flatnonzero(differ <= budget) + i

    return of


def links(fps: DataFrame, budget: int = 4, node_rows: int = NODE_ROWS) -> DataFrame:
    """(``least``, ``fp``): links of distinct fingerprints within ``budget`` bits, a spanning forest for each node pair.

    ``fps`` holds distinct values in ``fp``. The trie's cut is made from counts by prefix, at most
    2**MOST_DEPTH of them whatever the size of the input.
    """
    spark = fps.sparkSession
    schema = "least long, fp long"
    shift = BITS - MOST_DEPTH
    top = F.shiftrightunsigned("fp", shift)
    counts = {r[0]: r[1] for r in fps.groupBy(top.alias("p")).count().collect()}
    nodes = trie_nodes(counts, node_rows)
    if not nodes:
        return spark.createDataFrame([], schema)
    starts = np.array([p << (MOST_DEPTH - d) for p, d, _ in nodes], np.int64)
    pages = np.array([n for _, _, n in nodes], np.int64)
    first_page = np.concatenate([[0], np.cumsum(pages)])
    near = near_nodes(nodes, budget)
    total = int(first_page[-1])
    most = max(1, min(1024, 8 * spark.sparkContext.defaultParallelism, total * (total + 1) // 2))

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            node = np.searchsorted(starts, (fp >> np.uint64(shift)).astype(np.int64), side="right") - 1
            mixed = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            page = first_page[node] + (mixed % pages[node].astype(np.uint64)).astype(np.int64)
            order = np.argsort(page, kind="stable")
            page, fp = page[order], fp[order]
            at = np.flatnonzero(np.diff(page, prepend=-1))
            packed = [fp[a:b].tobytes() for a, b in zip(at, [*at[1:], len(page)])]
            yield pa.RecordBatch.from_arrays([pa.array(page[at]), pa.array(packed, pa.binary())], names=["page", "keys"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A packed part goes to every pair of pages that its page belongs to."""
        within = [near(i) for i in range(len(nodes))]
        before: list[list[int]] = [[] for _ in nodes]
        for i, found in enumerate(within):
            for j in found.tolist():
                before[j].append(i)
        for batch in batches:
            rows, size = {"a": [], "b": [], "side": [], "keys": []}, 0
            for page, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = b"".join(parts)
                node = int(np.searchsorted(first_page, page, side="right")) - 1
                for j in {*before[node], *within[node].tolist()}:
                    for other in range(first_page[j], first_page[j + 1]):
                        rows["a"].append(min(page, other))
                        rows["b"].append(max(page, other))
                        rows["side"].append(page == max(page, other))
                        rows["keys"].append(keys)
                        size += len(keys)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pydict(rows, schema=packed_schema)
                            rows, size = {"a": [], "b": [], "side": [], "keys": []}, 0
            if rows["a"]:
                yield pa.RecordBatch.from_pydict(rows, schema=packed_schema)

    packed_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("side", pa.bool_()), ("keys", pa.binary())])

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = key
        own = lambda side: np.sort(
            np.frombuffer(b"".join(pdf["keys"][pdf["side"] == side]), np.uint64)
        )
        if a == b:
            least, fp = node_links(own(True), None, budget)
        else:
            least, fp = node_links(own(False), own(True), budget)
        return pd.DataFrame({"least": least.view(np.int64), "fp": fp.view(np.int64)})

    # A page's keys come together first, NODE_ROWS on average at most, so that a pair of pages gets two rows.
    pages_of = fps.select("fp").mapInArrow(paged, "page long, keys binary").groupBy("page").agg(F.collect_list("keys"))
    sent = pages_of.mapInArrow(dealt, "a long, b long, side boolean, keys binary")
    return sent.repartition(most, "a", "b").groupBy("a", "b").applyInPandas(walk, schema)


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(``fp``, ``least``): the least node that each node of ``edges`` (least, fp) can reach.

    Each round every node hooks its neighbours on the least of them, then trees are halved; both are
    joins and grouped minima, cut by a checkpoint. Rounds grow with the logarithm of the longest path.
    """
    mark = F.xxhash64("u", "v")
    marks = (F.count("*"), F.bit_xor(mark), F.sum(mark.cast("decimal(20,0)")))
    pairs = edges.select(F.col("least").alias("u"), F.col("fp").alias("v"))
    state = reliable(pairs.where("u <> v").distinct())
    seen = state.agg(*marks).head()
    for _ in range(most_rounds):
        # Large star: the greater neighbours of u, and nothing else, are tied to the least around u.
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: the smaller neighbours of v, and v itself, are tied to the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        tied = large.join(low, "v")
        small = tied.select(F.col("m").alias("u"), F.col("u").alias("v")).union(tied.select(F.col("m").alias("u"), "v"))
        state = reliable(small.where("u <> v").distinct())
        before, seen = seen, state.agg(*marks).head()
        if before == seen:
            return state.select(F.col("v").alias("fp"), F.col("u").alias("least"))
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, budget: int = 4, node_rows: int = NODE_ROWS,
    keep_label: bool = False,
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits), ``component_id`` (least key reachable by links of ``budget`` bits).

    One row per row of ``docs``. With ``keep_label`` also ``component`` (its least fingerprint), which tells
    components apart whose least key is the same.
    """
    marked = written(fingerprints(docs, key, text, width), "simhash")
    distinct = reliable(marked.groupBy("fp").agg(F.min(key).alias("_first")))
    tied = components(links(distinct.select("fp"), budget, node_rows))
    label = F.coalesce("least", "fp")
    placed = distinct.join(tied, "fp", "left").select("fp", "_first", label.alias("_label"))
    # Sums up every fingerprint's first id by label before anything meets the documents.
    lowest = placed.groupBy("_label").agg(F.min("_first").alias("component_id"))
    more = [F.col("_label").alias("component")] if keep_label else []
    of_fp = placed.join(lowest, "_label").select("fp", "component_id", *more)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    columns = [c for c in of_fp.columns if c != "fp"]
    return marked.join(of_fp, "fp").select(F.col(key), digits.alias("fingerprint"), *columns)


def one_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """The documents whose key is their component's id, one row for each component.

    Of rows with one key in one component the least by fingerprint and text stays. Components with the same least
    key are told apart by the column ``component`` of ``found``, if it has one. ``width`` is that of ``found``. Rows without a key stay where no document of their component has one, one row per fingerprint.
    """
    own_text = unused(docs, "_text")
    by_key = found.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.col(key) == F.col("component_id")).alias("_stays"), F.count("*").alias("_n")
    )
    # Most keys stay and occur once; only the others are looked up.
    odd = reliable(by_key.where(~F.col("_stays") | (F.col("_n") > 1)))
    others = checked_broadcast(odd.select(key))
    repeated = checked_broadcast(odd.where("_stays").select(key))
    first = docs.join(others, key, "left_anti").where(F.col(key).isNotNull())
    named = first.select(*docs.columns)
    if not repeated.isEmpty():
        label = "component" if "component" in found.columns else "component_id"
        own = found.join(repeated, key, "left_semi").where(F.col(key) == F.col("component_id"))
        least = own.groupBy(key, label).agg(F.min("fingerprint").alias("fingerprint"))
        again = docs.join(repeated, key, "left_semi").withColumn(own_text, F.coalesce(F.col(f"`{text}`"), F.lit("")))
        texts = fingerprints(again.select(own_text).distinct(), own_text, own_text, width)
        texts = texts.select(own_text, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
        pairs = again.select(key, own_text).distinct().join(texts, own_text).join(least, [key, "fingerprint"])
        chosen = pairs.groupBy(key, label).agg(F.min(own_text).alias(own_text)).select(key, own_text)
        again = again.join(chosen, [key, own_text], "left_semi").dropDuplicates([key, own_text])
        named = named.unionByName(again.select(*docs.columns))
    bare = docs.where(F.col(key).isNull())
    marked = bare.withColumn(own_text, F.coalesce(F.col(f"`{text}`"), F.lit(""))).dropDuplicates([own_text])
    prints = fingerprints(marked, own_text, own_text, width).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    alone = found.where(F.col(key).isNull() & F.col("component_id").isNull()).select("fingerprint").distinct()
    chosen = prints.join(alone, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min(own_text).alias(own_text))
    return named.unionByName(marked.join(chosen, own_text, "left_semi").select(*docs.columns))
