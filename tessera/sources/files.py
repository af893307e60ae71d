"""Sources and sinks: provider JSON, CSV bars, positional arrays, quotes, panels, JSON lines, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tessera.functions.columns import AvailabilityPolicy, parse_number, roc_date
from tessera.operators.audit import Rule, violations

#: Schemas of provider rows and header names in two languages.
PRICE_ROWS = "date string, stock_id string, Trading_Volume long, Trading_money long, open double, max double, min double, close double, Trading_turnover long"
ALIASES = {
    "date": ("date", "日期"), "open": ("open", "開盤價"), "high": ("high", "max", "最高價"), "low": ("low", "min", "最低價"), "close": ("close", "收盤價"), "volume": ("volume", "成交股數", "成交量"),
}

#: One schema and its row rules for each kind of typed record.
KINDS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "market": ("instrument_id string, trade_date date, open double, high double, low double, close double, volume long, available_at timestamp", [("price_not_positive", "least(open, high, low, close) <= 0"), ("volume_negative", "volume < 0")]),
    "universe": ("instrument_id string, trade_date date, market string, eligible boolean, reasons array<string>", [("eligible_with_reasons", "eligible and size(reasons) > 0")]),
    "calendar": ("trade_date date, market string, status string", [("unknown_status", "status not in ('trading_day', 'holiday', 'unexpected_closure')")]),
    "action": ("instrument_id string, action_type string, ex_date date, ratio double, cash_amount double, available_at timestamp", [("ratio_not_positive", "ratio <= 0"), ("cash_amount_negative", "cash_amount < 0")]),
    "feature": ("instrument_id string, decision_time timestamp, feature_name string, value double, valid boolean", [("valid_without_value", "valid and value is null")]),
    "label": ("instrument_id string, decision_time timestamp, label_value double, valid boolean, label_interval_start timestamp, label_interval_end timestamp", [("valid_without_value", "valid and label_value is null"), ("interval_reversed", "label_interval_end < label_interval_start")]),
    "benchmark": ("trade_date date, level double", [("level_not_positive", "level <= 0")]),
}


def read_provider_json(spark: SparkSession, path: str, row_schema: str = PRICE_ROWS) -> DataFrame:
    """Rows of provider files ({status, msg, data: [...]}, one file a data set or data set__symbol), with `symbol` from the file's name."""
    files = spark.read.schema(f"status int, msg string, data array<struct<{_struct(row_schema)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"__([^_.]+)\.json$", 1)
    return files.select(F.nullif(name, F.lit("")).alias("symbol"), F.inline("data"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def read_bars_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejects) of CSV files with headers in either language, thousands commas and either calendar.

    bars: file, trade_date, open, high, low, close, volume; of a date that comes twice in a file the last line counts. rejects:
    file, line, reason. Bars need a date and positive prices."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    plain = {c: c.lstrip("﻿").strip().lower() for c in raw.columns}
    have = {k: next((c for c, p in plain.items() if p in names), None) for k, names in ALIASES.items()}
    if lost := [k for k, c in have.items() if c is None and k != "volume"]:
        raise ValueError(f"{path} lacks {lost}")
    num = lambda k: parse_number(F.col(f"`{have[k]}`")) if have[k] else F.lit(0.0)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), roc_date(F.col(f"`{have['date']}`")).alias("trade_date"), *(num(k).alias(k) for k in ("open", "high", "low", "close")), num("volume").cast("long").alias("volume"))
    reason = F.when(F.col("trade_date").isNull(), "bad_date").when(F.coalesce(F.least("open", "high", "low", "close") <= 0, F.lit(True)) | F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull(), "bad_price")
    judged = rows.withColumn("reason", reason)
    last = Window.partitionBy("file", "trade_date").orderBy(F.desc("line"))
    bars = judged.where("reason is null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "line", "reason")
    return bars, judged.where("reason is not null").select("file", "line", "reason")


def decode_exchange_rows(df: DataFrame, volume_multiplier: int = 1, rows: str = "rows") -> DataFrame:
    """Bars from arrays of text by place (date, volume, value, open, high, low, close); rows that cannot be read are left out."""
    one = df.withColumn("_r", F.explode(rows))
    at = lambda i: F.get("_r", F.lit(i))
    made = one.select(*(c for c in df.columns if c != rows), roc_date(at(0)).alias("trade_date"), (parse_number(at(1)) * volume_multiplier).cast("long").alias("volume"), parse_number(at(2)).alias("traded_value"), *(parse_number(at(3 + i)).alias(n) for i, n in enumerate(("open", "high", "low", "close"))))
    return made.where("trade_date is not null and open is not null and high is not null and low is not null and close is not null")


def _depth(prices: Column, volumes: Column) -> Column:
    """Up to five levels from two texts split by underscores; a missing volume is 0."""
    p, v = F.split(prices, "_"), F.split(volumes, "_")
    levels = F.transform(F.arrays_zip(p.alias("p"), v.alias("v")), lambda x: F.struct(x["p"].try_cast("double").alias("price"), F.coalesce(x["v"].try_cast("long"), F.lit(0).cast("long")).alias("volume")))
    return F.slice(F.filter(levels, lambda x: x["price"].isNotNull()), 1, 5)


def decode_quotes(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(symbol, name, event_time, price, previous_close, open, high, low, volume, bids, asks, status) of every symbol asked for.

    price: the first of z, pz and y that is a number other than zero; status ok (z is a number, zero included), reference
    (an older price), or not_found (not returned; all but symbol and name are null). df: symbol, z, pz, y, a, f, b, g as text, and where
    the snapshot has them n (name; the symbol, if not), d and t (day yyyymmdd and time in Taipei; both or no event_time), o, h, l
    and v (whole number)."""
    have = set(df.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    num = lambda c: parse_number(text(c))
    price = F.coalesce(*(F.nullif(num(c), F.lit(0.0)) for c in ("z", "pz", "y")))
    at = F.when(F.length(text("d")) == 8, F.try_to_timestamp(F.concat(text("d"), F.lit(" "), text("t"), F.lit(" +08:00")), F.lit("yyyyMMdd HH:mm:ss XXX")))
    traded = {"open": num("o"), "high": num("h"), "low": num("l"), "volume": num("v").cast("long")}
    decoded = df.select("symbol", text("n").alias("name"), at.alias("event_time"), price.alias("price"), num("y").alias("previous_close"), *(c.alias(n) for n, c in traded.items()), _depth(F.col("b"), F.col("g")).alias("bids"), _depth(F.col("a"), F.col("f")).alias("asks"), F.when(num("z").isNotNull(), "ok").otherwise("reference").alias("status"))
    met = watchlist.select("symbol").distinct().join(decoded, "symbol", "left")
    return met.withColumns({"status": F.coalesce("status", F.lit("not_found")), "name": F.coalesce("name", "symbol")})


def write_panel(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet with zstd, rows of a file sorted by all plain columns."""
    order = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    writer = df.sortWithinPartitions(*(partition_by or []), *[c for c in order if c not in (partition_by or [])]).write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_panel(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines; returns how many were written, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def read_jsonl(spark: SparkSession, path: str, schema: str, expected: int | None = None) -> DataFrame:
    """JSON lines under a schema; with `expected`, their number must be that."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{path} has {n} records, not {expected}")
    return df


def read_typed(spark: SparkSession, kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of JSON lines of a kind."""
    schema, rules = KINDS[kind]
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    keys = [c for c in ("instrument_id", "trade_date", "decision_time", "feature_name") if c in df.columns]
    return df, violations(df, [Rule(code, F.expr(test)) for code, test in rules], keys)


def register_panel(df: DataFrame, name: str) -> None:
    """A view by name for SQL."""
    df.createOrReplaceTempView(name)


def read_cached_bars(spark: SparkSession, path: str, symbols: list[str], start: str, end: str, market: str = "TWSE") -> DataFrame:
    """Provider bars of some symbols and dates as decimals, known from 18:00; only the symbols' files are read."""
    rows = read_provider_json(spark, f"{path}/*__{{{','.join(symbols)}}}.json")
    day = F.col("date").cast("date")
    price = lambda c: F.col(c).cast("decimal(20,8)")
    return rows.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(F.concat(F.lit(f"{market}:"), F.col("stock_id")).alias("instrument_id"), day.alias("trade_date"), price("open").alias("open"), price("max").alias("high"), price("min").alias("low"), price("close").alias("close"), F.col("Trading_Volume").alias("volume"), AvailabilityPolicy().available(day).alias("available_at"))


def write_report(path: str, most: int = 10_000, **parts: DataFrame) -> dict:
    """Small result tables as one JSON document; refuses parts that are no summaries (over `most` rows)."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(most + 1).toJSON().collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} rows; a report holds summaries")
        out[name] = [json.loads(r) for r in rows]
    next(iter(parts.values())).sparkSession.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.text(path)
    return out


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; refuses one that is no summary (over `most` rows)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of over {most} rows is no summary")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def alert_sink(df: DataFrame, path: str, checkpoint: str | None = None):
    """Append alerts as JSON lines; returns the query if they are a stream."""
    if df.isStreaming:
        return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint or f"{path}/_checkpoint").outputMode("append").trigger(availableNow=True).start()
    df.write.mode("append").json(path)
    return None
