"""Folders of a stream, and streams that write each micro-batch to several tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalmill.session import listed

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Store:
    """Folder of a stream: its outputs and the query's checkpoint."""

    path: str

    def output_path(self, name: str) -> str:
        return f"{self.path}/out/{name}"

    @property
    def rows_path(self) -> str:
        """Rows of a query with keyed state, all its outputs together."""
        return f"{self.path}/rows"

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"

    def last_batch(self, spark: SparkSession) -> int:
        """The last complete batch by Spark's own commit log, -1 if there is none."""
        return max((int(name) for name in listed(spark, f"{self.checkpoint}/commits") if name.isdigit()), default=-1)

    def output(self, spark: SparkSession, name: str) -> DataFrame:
        """Everything that complete batches emitted; where batches have folders of their own, with its number."""
        if listed(spark, self.rows_path):
            return spark.read.parquet(self.rows_path).where(F.col("output") == name).select(f"{name}.*")
        rows = spark.read.option("basePath", self.output_path(name)).parquet(self.output_path(name))
        return rows.where(F.col("batch") <= self.last_batch(spark))


def run_batches(
    stream: DataFrame, store: Store, step: Callable[[DataFrame], Tables], trigger: dict | None = None,
    partitions: dict[str, list[str]] | None = None,
) -> StreamingQuery:
    """Start a query that writes the tables of ``step`` of every micro-batch.

    A batch's files lie in folders named by its number, so that a repeated batch overwrites its own.
    ``partitions`` names the partition columns of tables that have any.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # The tables read the rows several times; lost cached blocks are read again from the source.
        rows = batch.persist()
        try:
            for name, df in step(rows).items():
                by = (partitions or {}).get(name, [])
                # Small partitions share a task, a hot one is split over several.
                laid_out = df.hint("rebalance", *by) if by else df
                laid_out.write.mode("overwrite").partitionBy(*by).parquet(f"{store.output_path(name)}/batch={batch_id}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", store.checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
