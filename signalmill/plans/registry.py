"""Registry of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` may use the view names of :mod:`signalmill.plans.views`."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(fn(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = views.with_views(sql)
        return fn

    return register


def flat(df: DataFrame) -> DataFrame:
    """Columns in forms both engines print alike: epoch microseconds, longs, doubles to 6 digits."""

    def one(field: T.StructField):
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.unix_micros(col.cast("timestamp"))
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
            col = F.to_json(col)
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, T.BinaryType):
            col = F.decode(col, "UTF-8")
        return col.alias(field.name)

    return df.select(*map(one, df.schema.fields))
