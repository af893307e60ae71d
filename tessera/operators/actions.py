"""Corporate actions: constraints, unsupported cases, and price views adjusted backward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.audit import Rule, violations
from tessera.operators.grid import asof_backward
from tessera.operators.universe import filter_available, latest_revision

SPLITS = ("stock_split", "reverse_split", "stock_dividend")


def action_rules() -> list[Rule]:
    """What each kind of action must carry."""
    kind = F.col("action_type")
    return [
        Rule("missing_ratio", kind.isin(*SPLITS) & F.col("ratio").isNull()),
        Rule("ratio_not_positive", F.col("ratio") <= 0),
        Rule("missing_cash_amount", (kind == "cash_dividend") & F.col("cash_amount").isNull()),
        Rule("cash_amount_negative", F.col("cash_amount") < 0),
        Rule("missing_ex_date", kind.isin("cash_dividend", *SPLITS) & F.col("ex_date").isNull()),
        Rule("available_before_announcement", F.col("available_at") < F.col("announcement_time")),
        Rule("missing_symbols", (kind == "symbol_change") & (F.col("old_symbol").isNull() | F.col("new_symbol").isNull())),
    ]


def unsupported_actions(actions: DataFrame) -> DataFrame:
    """(instrument_id, ex_date, code): rights issues, capital reductions other than loss offset, several adjustments on one day."""
    kind = F.col("action_type")
    code = F.when(kind == "rights_issue", "rights_issue").when((kind == "capital_reduction") & ~F.col("capital_reduction_subtype").eqNullSafe("loss_offset"), "capital_reduction")
    alone = actions.select("instrument_id", "ex_date", code.alias("code")).where("code is not null")
    many = actions.where(kind.isin("cash_dividend", *SPLITS)).groupBy("instrument_id", "ex_date").agg(F.count("*").alias("_n")).where("_n > 1").select("instrument_id", "ex_date", F.lit("several_adjusting_actions").alias("code"))
    return alone.unionByName(many)


def effective_actions(actions: DataFrame, decision_time: Column | None = None) -> DataFrame:
    """The latest revision of each event, of those known at the decision time."""
    return latest_revision(actions, ["source", "source_event_id"], "revision", decision_time)


def price_views(bars: DataFrame, actions: DataFrame, decision_time: Column | None = None) -> DataFrame:
    """Bars with split and total-return factors, and adjusted closes and volume.

    A day's split factor divides by the ratios of the splits that take effect after it; its cash factor multiplies
    (previous close - amount) / previous close of the dividends after it. Actions join the bars of their
    instrument on the time axis; one ordered window each way, no range join. Returns instrument_id, trade_date, close,
    volume, split_factor, cash_factor, split_close, total_return_close, split_volume and ohlc_ok."""
    known = effective_actions(actions, decision_time)
    split = F.when(F.col("action_type").isin(*SPLITS), F.col("ratio"))
    cash = F.when(F.col("action_type") == "cash_dividend", F.col("cash_amount"))
    dated = known.where("ex_date is not null").select("instrument_id", "ex_date", split.alias("ratio"), cash.alias("cash"))
    priced = asof_backward(dated, bars, ["instrument_id"], "ex_date", "trade_date", ["close"])
    factors = priced.select("instrument_id", F.col("ex_date").alias("_t"), F.coalesce(1 / F.nullif("ratio", F.lit(0.0)), F.lit(1.0)).alias("_s"), F.when(F.col("cash").isNotNull() & (F.col("asof_close") > 0), (F.col("asof_close") - F.col("cash")) / F.nullif("asof_close", F.lit(0.0))).otherwise(1.0).alias("_c"))
    rows = bars.withColumn("_t", F.col("trade_date")).withColumn("_bar", F.lit(1)).unionByName(factors.withColumn("_bar", F.lit(0)), allowMissingColumns=True)
    # Later days first; a factor counts for bars strictly before its day.
    later = Window.partitionBy("instrument_id").orderBy(F.desc("_t"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, -1)
    made = rows.withColumn("split_factor", F.coalesce(F.product("_s").over(later), F.lit(1.0))).withColumn("cash_factor", F.coalesce(F.product("_c").over(later), F.lit(1.0))).where("_bar = 1")
    ok = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    return made.select("instrument_id", "trade_date", "close", "volume", "split_factor", "cash_factor", (F.col("close") * F.col("split_factor")).alias("split_close"), (F.col("close") * F.col("split_factor") * F.col("cash_factor")).alias("total_return_close"), F.round(F.col("volume") / F.col("split_factor")).cast("long").alias("split_volume"), ok.alias("ohlc_ok"))


def late_announcements(actions: DataFrame, clock_hours: int = 10) -> DataFrame:
    """Actions in effect on a day but known only after that day's decision; flagged, not dropped."""
    decided = F.col("ex_date").cast("timestamp") + F.expr(f"INTERVAL {clock_hours} HOURS")
    return actions.where(F.col("available_at") > decided)


def action_violations(actions: DataFrame) -> DataFrame:
    return violations(actions, action_rules(), ["source", "source_event_id"])


__all__ = ["action_rules", "action_violations", "effective_actions", "filter_available", "late_announcements", "price_views", "unsupported_actions"]
