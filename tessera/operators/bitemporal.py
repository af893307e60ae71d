"""Joins on two clocks: what a decision knew (knowledge time) of what takes effect when (effective time).

A revision of an event is known from the moment it is available until a higher one is. These knowledge intervals,
numbered by the moments at which anything changes, are laid on a tree of dyadic blocks: an interval of n moments
is at most 2 log2 n blocks, and a decision meets an interval in exactly one block that holds its moment. So a
condition on both clocks becomes equality of blocks and one ordered window by effective time within each: no
inequality join, no list of all events a decision, and work of (revisions + decisions) * log2 of the moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.actions import SPLITS
from tessera.operators.grid import asof_backward


def knowledge_intervals(revisions: DataFrame, keys: list[str], revision: str = "revision", known: str = "available_at") -> DataFrame:
    """The revisions that were ever the effective one of their key, with known_from and known_to (null: to this day).

    A revision counts from `known` on if it is higher than all before; of those that arrive at one moment the highest counts; one
    that arrives after a higher one, and one that was never available, never does. Of equal revisions the first known stays."""
    order = Window.partitionBy(*keys).orderBy(known, F.desc(revision))
    higher = F.max(revision).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = revisions.where(F.col(known).isNotNull()).withColumn("_before", higher).where(F.col("_before").isNull() | (F.col(revision) > F.col("_before"))).drop("_before")
    return rows.withColumn("known_from", F.col(known)).withColumn("known_to", F.lead(known).over(order))


def revisions_as_of(decisions: DataFrame, revisions: DataFrame, keys: list[str], values: list[str], revision: str = "revision", known: str = "available_at", at: str = "decision_time") -> DataFrame:
    """Each decision with `values` of the revision of its key that was the latest known at its time (known_<value>; null if none).

    decisions: the keys, `at` and any others; there may be any number a key. One sort of both sides by key and time."""
    found = asof_backward(decisions, knowledge_intervals(revisions, keys, revision, known), keys, at, "known_from", values, strict=False)
    return found.select(*decisions.columns, *(F.col(f"asof_{v}").alias(f"known_{v}") for v in values))


def _blocks(low: Column, high: Column) -> Column:
    """The dyadic blocks (level, number) that make up the moments low <= m < high."""

    def at_level(j: Column) -> Column:
        size = F.pow(F.lit(2.0), j).cast("long")
        first, stop = F.ceil(low / size), F.floor(high / size)
        block = lambda n: F.struct(j.cast("int").alias("level"), n.cast("long").alias("number"))
        left = F.when((first < stop) & (first % 2 == 1), block(first))
        right = F.when((first < stop) & (stop % 2 == 1), block(stop - 1))
        return F.filter(F.array(left, right), lambda b: b.isNotNull())

    levels = F.sequence(F.lit(0), F.ceil(F.log2(high + 1)).cast("int"))
    return F.flatten(F.transform(levels, at_level))


def products_as_of(decisions: DataFrame, effects: DataFrame, factors: list[str], by: str, day: str, effective: str, at: str, salts: int = 1) -> DataFrame:
    """(by, day, at, factors...): for each different decision the products of the factors of the effects that it knew
    (known_from <= at < known_to) and that take effect after its day (effective > day); 1 without any.

    effects: by, effective, known_from, known_to (null: open), factors; a null effective day or factor has no part in a product, but may have
    replaced one that had. salts: into how many groups the decisions of one key are dealt; its effects go to each."""
    asked = decisions.select(by, day, at).distinct()
    moments = effects.select(by, F.col("known_from").alias("_m")).union(effects.select(by, "known_to")).where("_m is not null").distinct()
    order = Window.partitionBy(by).orderBy("_m")
    numbered = moments.withColumn("_slot", F.row_number().over(order).cast("long")).withColumn("_last", F.count("*").over(Window.partitionBy(by)))
    # Moments are numbered from 1; a decision before all of them knows nothing and needs no block.
    placed = asof_backward(asked, numbered, [by], at, "_m", ["_slot", "_last"], strict=False)
    begun = effects.where(F.col(effective).isNotNull()).join(numbered.select(by, F.col("_m").alias("known_from"), F.col("_slot").alias("_low"), "_last"), [by, "known_from"])
    ended = numbered.select(by, F.col("_m").alias("known_to"), F.col("_slot").alias("_high"))
    ranged = begun.join(ended, [by, "known_to"], "left").withColumn("_high", F.coalesce("_high", F.col("_last") + 1))
    salt = F.pmod(F.xxhash64(day, at), F.lit(salts)).cast("int")
    kept = ranged.select(by, F.explode(_blocks(F.col("_low"), F.col("_high"))).alias("_b"), F.col(effective).alias("_t"), *factors)
    kept = kept.select(by, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), "_b", "_t", F.lit(1).alias("_side"), *factors)
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("asof__last") + 2)).cast("int"))
    visited = F.transform(levels, lambda j: F.struct(j.alias("level"), F.floor(F.col("asof__slot") / F.pow(F.lit(2.0), j)).cast("long").alias("number")))
    seen = placed.where("asof__slot is not null").select(by, salt.alias("_salt"), F.explode(visited).alias("_b"), F.col(day).alias("_t"), F.lit(0).alias("_side"), day, at)
    both = seen.unionByName(kept, allowMissingColumns=True)
    later = Window.partitionBy(by, "_salt", "_b").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, -1)
    made = both.select(by, day, at, "_side", *(F.product(f).over(later).alias(f) for f in factors)).where("_side = 0")
    whole = made.groupBy(by, day, at).agg(*(F.product(f).alias(f) for f in factors))
    return asked.join(whole, [by, day, at], "left").select(by, day, at, *(F.coalesce(f, F.lit(1.0)).alias(f) for f in factors))


def action_effects(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """The knowledge intervals of corporate actions with split_factor and cash_factor, what each multiplies prices before its day by.

    A split divides by its ratio; a dividend multiplies by (previous close - amount) / previous close. actions: instrument_id,
    source, source_event_id, revision, available_at, action_type, ex_date, ratio, cash_amount."""
    known = knowledge_intervals(actions, ["source", "source_event_id"])
    priced = asof_backward(known, bars, ["instrument_id"], "ex_date", "trade_date", ["close"])
    split = F.when(F.col("action_type").isin(*SPLITS), 1 / F.nullif("ratio", F.lit(0.0)))
    cash = F.when((F.col("action_type") == "cash_dividend") & (F.col("asof_close") > 0), (F.col("asof_close") - F.col("cash_amount")) / F.nullif("asof_close", F.lit(0.0)))
    return priced.select("instrument_id", "ex_date", "known_from", "known_to", split.alias("split_factor"), cash.alias("cash_factor"))


def price_views_as_of(decisions: DataFrame, bars: DataFrame, actions: DataFrame, salts: int = 1) -> DataFrame:
    """Each decision's bar as the decision saw it: split_factor, cash_factor, split_close, total_return_close, split_volume.

    decisions: instrument_id, trade_date (the bar), decision_time (what is known) and any others, in any number; bars: instrument_id, trade_date,
    close, volume. The same as actions.price_views with one decision time, for all of them at once. A decision without a bar has
    factors and no prices; repeated decisions come out as often."""
    factors = products_as_of(decisions, action_effects(bars, actions), ["split_factor", "cash_factor"], "instrument_id", "trade_date", "ex_date", "decision_time", salts)
    rows = decisions.join(factors, ["instrument_id", "trade_date", "decision_time"], "left").join(bars.select("instrument_id", "trade_date", "close", "volume"), ["instrument_id", "trade_date"], "left")
    close = F.col("close") * F.col("split_factor")
    return rows.select(*decisions.columns, "close", "split_factor", "cash_factor", close.alias("split_close"), (close * F.col("cash_factor")).alias("total_return_close"), F.round(F.col("volume") / F.col("split_factor")).cast("long").alias("split_volume"))
