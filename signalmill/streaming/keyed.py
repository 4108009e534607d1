"""Streams with keyed state in Spark's state store.

State variables belong to a key of a grouped stream: a micro-batch loads and writes those of its own keys only,
and Spark versions them with the query's checkpoint, so a repeated batch starts from the same state. Outputs go
through Spark's file sink, which adds the files of complete batches only. One query may have several outputs:
its rows have the output's name and one struct for each output.

A key has its own clock, for feeds of many tenants mix clocks: rows wait until their key has seen a row that is newer by the lateness,
and no key waits for another or makes another's rows late. Rows of one key and micro-batch come to one task;
where only numbers are needed they come packed, one row of arrays for each key and Arrow batch, or summed up.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from signalmill.functions.time import Duration, micros

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of rows without one.
NO_TIME = -(1 << 62)


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep state variables; they have Spark's RocksDB store, other queries what the session has."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def transform(
    rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType | str, idle: Duration | None = None
) -> DataFrame:
    """Rows by key through a processor; with ``idle`` its state variables expire, so the query never comes to an end by itself."""
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "processingTime" if idle else "none")


def ttl(idle: Duration | None, trigger: dict | None) -> int | None:
    """``idle`` in milliseconds; it needs a trigger that goes on."""
    if idle and (not trigger or trigger.get("availableNow") or trigger.get("once")):
        raise ValueError("idle needs a trigger that goes on, as processingTime")
    return micros(idle) // 1000 if idle else None


def write_outputs(rows: DataFrame, store, outputs: dict[str, list[Column]], trigger: dict | None = None) -> StreamingQuery:
    """Start a query whose rows go to the output that their column ``output`` names, with that output's columns."""
    structs = [F.when(F.col("output") == name, F.struct(*columns)).alias(name) for name, columns in outputs.items()]
    writer = rows.select("output", *structs).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", store.rows_path).option("checkpointLocation", store.checkpoint)
    with state_store(rows.sparkSession):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def at_micros(time: str) -> Column:
    return F.coalesce(F.unix_micros(time), F.lit(NO_TIME))


def time_of(at: str) -> Column:
    return F.when(F.col(at) != NO_TIME, F.timestamp_micros(F.col(at)))


def packed(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``rows`` with their ``columns`` (numpy types by name) as arrays of bytes, one row for each key and Arrow batch."""
    kept = rows.select(*keys, *columns)
    schema = T.StructType([*(kept.schema[k] for k in keys), *(T.StructField(c, T.BinaryType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            group, first = key_groups([batch.column(i) for i in range(len(keys))])
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(1, len(first)))
            arrays = []
            for i, kind in enumerate(columns.values(), len(keys)):
                values = batch.column(i).to_numpy(zero_copy_only=False).astype(kind)[order]
                arrays.append(pa.array([part.tobytes() for part in np.split(values, cuts)], pa.binary()))
            named = [batch.column(i).take(pa.array(first)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*named, *arrays], names=schema.names)

    return kept.mapInArrow(run, schema)


def key_groups(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's key, nulls being keys too, and the first row of each key."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        encoded = pc.fill_null(pc.cast(column.dictionary_encode().indices, pa.int64()), -1).to_numpy() + 1
        _, code = np.unique(code * (encoded.max(initial=0) + 1) + encoded, return_inverse=True)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def unpacked(frames: Iterator[pd.DataFrame], columns: dict[str, str]) -> pd.DataFrame:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in columns}
    for frame in frames:
        for c, kind in columns.items():
            parts[c] += [np.frombuffer(b, kind) for b in frame[c]]
    return pd.DataFrame({c: np.concatenate(p) if p else np.zeros(0, columns[c]) for c, p in parts.items()})


class Ordered:
    """A key's rows in the order of (``at_us``, id) across micro-batches, with their clock and held rows as state."""

    def __init__(self, row_id: str, lateness: Duration | None, ttl: int | None):
        self.row_id, self.lateness, self.ttl = row_id, micros(lateness) if lateness else 0, ttl

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "passed long", self.ttl)
        self.held = handle.getValueState("held", "rows binary", self.ttl) if self.lateness else None

    def pass_on(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(rows to work on, in order; rows older than one passed on, or without a time)."""
        passed = self.clock.get()[0] if self.clock.exists() else NO_TIME + 1
        timely = rows["at_us"] >= passed
        late, rows = rows[~timely], rows[timely]
        if self.held is not None and self.held.exists():
            held = pa.ipc.open_stream(self.held.get()[0]).read_all().to_pandas()
            rows = pd.concat([held, rows], ignore_index=True)
        if not len(rows):
            return rows, late
        upto = max(passed, int(rows["at_us"].max()) - self.lateness)
        ready = rows[rows["at_us"] <= upto] if self.held is not None else rows
        if self.held is not None:
            table = pa.Table.from_pandas(rows[rows["at_us"] > upto], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            if len(table):
                self.held.update((sink.getvalue().to_pybytes(),))
            else:
                self.held.clear()
        if len(ready):
            # Where nothing is held back, rows of the newest time may still come.
            self.clock.update((int(ready["at_us"].max()),))
        return ready.sort_values(["at_us", self.row_id], kind="stable", ignore_index=True), late
