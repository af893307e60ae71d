"""Observations of a bar's field as JSON text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What an observation holds, by name; the text has the keys in this order.
OBSERVATION = "available_at timestamp, field string, trade_date date, value double"


def encode_observation(day: Column, field: str, value: Column, available_at: Column) -> Column:
    """JSON text of one observed value; null without a day. A null value or time is written as null."""
    made = F.struct(available_at.cast("timestamp").alias("available_at"), F.lit(field).alias("field"), day.alias("trade_date"), value.cast("double").alias("value"))
    return F.when(day.isNotNull(), F.to_json(made, {"ignoreNullFields": "false"}))


def decode_observations(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the other columns with the parts of an observation, and those whose text is not one, with the text.

    A text is rejected if it is not JSON of the types of OBSERVATION, or lacks the day or the field. Null texts are in neither."""
    others = [c for c in df.columns if c != column]
    parsed = df.where(F.col(f"`{column}`").isNotNull()).withColumn("_o", F.from_json(F.col(f"`{column}`"), f"{OBSERVATION}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_o._bad").isNotNull() | F.col("_o.trade_date").isNull() | F.col("_o.field").isNull()
    kept = [F.col(f"`{c}`") for c in others]
    rows = parsed.where(~bad).select(*kept, *(F.col(f"_o.{p.split()[0]}") for p in OBSERVATION.split(", ")))
    return rows, parsed.where(bad).select(*kept, F.col(f"`{column}`"))
