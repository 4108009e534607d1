"""User hook that rewrites signals."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def enrich_hook(df: DataFrame, fn: Callable[[dict], dict | None]) -> DataFrame:
    """Pass every row through ``fn`` as a JSON object; adds ``enrich_error``.

    ``fn`` returns the enriched object, or ``None`` to leave the row as it is. A failing call, and a
    result whose values do not fit the columns, keep the input row and report the error.
    """

    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, errors = [], []
            for text in part:
                out, error = None, None
                try:
                    changed = fn(json.loads(text))
                    if not isinstance(changed, dict | None):
                        raise TypeError(f"an object or None is expected, not {type(changed).__name__}")
                    out = None if changed is None else json.dumps(changed)
                except Exception as exc:
                    error = f"{type(exc).__name__}: {exc}"
                texts.append(out)
                errors.append(error)
            yield pd.DataFrame({"text": texts, "error": errors}, dtype="object")

    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
    call = F.pandas_udf(rewrite, result)
    called = df.withColumn("_out", call(F.to_json(F.struct(*df.columns), {**_TIME, "ignoreNullFields": "false"})))
    unfit = "_unfit"
    schema = T.StructType([*df.schema.fields, T.StructField(unfit, T.StringType())])
    parsed = called.withColumn("_new", F.from_json("_out.text", schema, {**_TIME, "columnNameOfCorruptRecord": unfit}))
    changed = F.col("_out.text").isNotNull() & F.col(f"_new.{unfit}").isNull()
    misfit = F.when(F.col(f"_new.{unfit}").isNotNull(), F.concat(F.lit("TypeError: result does not fit: "), f"_new.{unfit}"))
    return parsed.select(
        *[F.when(changed, F.col(f"_new.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns],
        F.coalesce("_out.error", misfit).alias("enrich_error"),
    )
