"""Rolling features over a dense grid, and row factors over an instrument's own rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import AvailabilityPolicy

#: Names no feature may read: they tell the future.
FORBIDDEN = ("label_value", "raw_return", "benchmark_return", "target")


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: its inputs, how many sessions it needs, and its column over a window of one instrument by session."""

    name: str
    version: str
    inputs: tuple[str, ...]
    min_obs: int
    build: Callable[[Window], Column]

    def __post_init__(self) -> None:
        if bad := set(self.inputs) & set(FORBIDDEN):
            raise ValueError(f"{self.name} reads {sorted(bad)}")


class Registry:
    """Specs by name and version; a name and version may not be given another meaning."""

    def __init__(self) -> None:
        self._specs: dict[tuple[str, str], FeatureSpec] = {}

    def add(self, spec: FeatureSpec) -> FeatureSpec:
        old = self._specs.setdefault((spec.name, spec.version), spec)
        if old is not spec and (old.inputs, old.min_obs) != (spec.inputs, spec.min_obs):
            raise ValueError(f"{spec.name} {spec.version} is registered with another definition")
        return old

    def all(self) -> list[FeatureSpec]:
        return list(self._specs.values())


REGISTRY = Registry()


def _frame(w: Window, first: int, last: int = 0) -> Window:
    return w.rowsBetween(first, last)


def _past(n: int) -> Callable[[Window], Column]:
    return lambda w: F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1


def _register() -> None:
    close, volume, value = ("close",), ("volume",), ("close", "traded_value")
    add = lambda name, inputs, n, build: REGISTRY.add(FeatureSpec(name, "v1", inputs, n, build))
    add("reversal_1", close, 2, lambda w: -(F.try_divide(F.col("close"), F.lag("close", 1).over(w)) - 1))
    for n in (5, 20, 60):
        add(f"momentum_{n}", close, n + 1, _past(n))
    add("realized_volatility_20", close, 21, lambda w: F.stddev_samp("_return").over(_frame(w, -19)))
    add("downside_volatility_20", close, 21, lambda w: F.sqrt(F.avg(F.pow(F.least("_return", F.lit(0.0)), 2)).over(_frame(w, -19))))
    add("average_traded_value_20", ("traded_value",), 20, lambda w: F.avg("traded_value").over(_frame(w, -19)))
    add("volume_activity_proxy_20", volume, 20, lambda w: F.try_divide(F.col("volume"), F.avg("volume").over(_frame(w, -19))))
    add("amihud_illiquidity_20", value, 21, lambda w: F.avg(F.try_divide(F.abs("_return"), F.col("traded_value"))).over(_frame(w, -19)))
    add("overnight_return", ("open", "close"), 2, lambda w: F.try_divide(F.col("open"), F.lag("close", 1).over(w)) - 1)
    add("intraday_return", ("open", "close"), 1, lambda w: F.col("close") / F.nullif("open", F.lit(0.0)) - 1)
    add("price_to_moving_average_20", close, 20, lambda w: F.try_divide(F.col("close"), F.avg("close").over(_frame(w, -19))) - 1)
    add("distance_from_rolling_high_20", ("close", "high"), 20, lambda w: F.try_divide(F.col("close"), F.max("high").over(_frame(w, -19))) - 1)
    add("volume_surprise_20", volume, 21, lambda w: F.try_divide(F.col("volume"), F.avg("volume").over(_frame(w, -20, -1))) - 1)


_register()


def compute_features(bars: DataFrame, universe: DataFrame, sessions: DataFrame, specs: list[FeatureSpec] | None = None, policy: AvailabilityPolicy = AvailabilityPolicy()) -> DataFrame:
    """Long features of the eligible members on their sessions.

    bars: instrument_id, trade_date, prices, volume, traded_value, available_at; universe: instrument_id, trade_date,
    eligible (and market); sessions: trade_date, market, session_idx. A window covers sessions, not rows: a missing one makes it
    invalid. Returns instrument_id, decision_date, decision_time, feature_name, feature_version, value, valid and
    invalid_reason, the first that applies. All windows share one sort by instrument and session.
    """
    specs = specs or REGISTRY.all()
    from tessera.operators.grid import dense_grid, on_grid

    grid = on_grid(dense_grid(universe.select("instrument_id", "market").distinct(), sessions), bars)
    w = Window.partitionBy("instrument_id").orderBy("session_idx")
    decision = policy.available(F.col("trade_date"))
    full = grid.withColumn("decision_time", decision).withColumn("_has", F.col("available_at").isNotNull().cast("int")).withColumn("_n", F.row_number().over(w)).withColumn("_previous", F.lag("close", 1).over(w))
    full = full.withColumn("_return", F.col("close") / F.nullif("_previous", F.lit(0.0)) - 1)

    def reason(spec: FeatureSpec, value: Column) -> Column:
        own = _frame(w, 1 - spec.min_obs)
        bad = lambda test: F.max(F.when(F.col("_has") == 1, test).otherwise(False)).over(own)
        numbers = [F.col(c).cast("double") for c in spec.inputs]
        prices = [F.col(c) for c in spec.inputs if c in ("open", "high", "low", "close")]
        any_of = lambda tests: F.greatest(F.lit(False), *tests) if tests else F.lit(False)
        chain = F.when(F.col("_n") < spec.min_obs, "insufficient_lookback")
        chain = chain.when(F.sum("_has").over(own) < spec.min_obs, "provider_missing_or_suspended_session")
        chain = chain.when(F.max("available_at").over(own) > F.col("decision_time"), "observation_not_available_at_decision")
        chain = chain.when(bad(F.coalesce(F.col("volume") <= 0, F.lit(False))), "zero_volume_or_suspended_observation")
        chain = chain.when(bad(any_of([c.isNull() for c in numbers])), "missing_required_input")
        chain = chain.when(bad(any_of([F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)) for c in numbers])), "non_finite_input")
        chain = chain.when(bad(any_of([F.coalesce(c <= 0, F.lit(False)) for c in prices])), "non_positive_price_input")
        if "traded_value" in spec.inputs:
            chain = chain.when(bad(F.coalesce(F.col("traded_value") <= 0, F.lit(False))), "non_positive_traded_value")
        return chain.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "non_finite_result")

    # First every windowed value, then the reasons: both in the one sort of w.
    valued = full.select("*", *(s.build(w).alias(f"_v_{s.name}") for s in specs))
    judged = valued.select("*", *(reason(s, F.col(f"_v_{s.name}")).alias(f"_r_{s.name}") for s in specs))
    long = judged.select("instrument_id", F.col("trade_date").alias("decision_date"), "decision_time", F.explode(F.array(*(F.struct(F.lit(s.name).alias("feature_name"), F.lit(s.version).alias("feature_version"), F.col(f"_v_{s.name}").alias("raw"), F.col(f"_r_{s.name}").alias("invalid_reason")) for s in specs))).alias("f"))
    member = universe.where("eligible").select("instrument_id", F.col("trade_date").alias("decision_date"))
    out = long.join(member, ["instrument_id", "decision_date"], "left_semi")
    return out.select("instrument_id", "decision_date", "decision_time", "f.feature_name", "f.feature_version", F.when(F.col("f.invalid_reason").isNull(), F.col("f.raw")).alias("value"), F.col("f.invalid_reason").isNull().alias("valid"), "f.invalid_reason")


def _position(n: int) -> Callable[[Window], Column]:
    def build(w: Window) -> Column:
        low, high = F.min("low").over(_frame(w, 1 - n)), F.max("high").over(_frame(w, 1 - n))
        return F.when(high == low, F.lit(0.0)).otherwise((F.col("close") - low) / F.nullif(high - low, F.lit(0.0)))

    return build


def row_factor_specs() -> dict[str, tuple[int, Callable[[Window], Column]]]:
    """Factors over an instrument's own rows: key -> (rows needed, column)."""
    mean = lambda c, n: lambda w: F.avg(c).over(_frame(w, 1 - n))
    out: dict[str, tuple[int, Callable[[Window], Column]]] = {}
    for n in (5, 10, 20, 60):
        out[f"momentum_{n}"] = (n + 1, _past(n))
    for n in (3, 5, 10):
        out[f"reversal_{n}"] = (n + 1, lambda w, n=n: -(F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1))
    for n in (5, 10, 20):
        out[f"volatility_{n}"] = (n + 1, lambda w, n=n: F.stddev_samp("_log").over(_frame(w, 1 - n)) * F.sqrt(F.lit(252.0)))
    for n in (5, 20):
        out[f"volume_ratio_{n}"] = (n, lambda w, n=n: F.col("volume") / F.nullif(mean("volume", n)(w), F.lit(0.0)))
    for a, b in ((5, 20), (10, 60), (20, 60)):
        out[f"ma_gap_{a}_{b}"] = (b, lambda w, a=a, b=b: mean("close", a)(w) / F.nullif(mean("close", b)(w), F.lit(0.0)) - 1)
    for n in (10, 20, 60):
        out[f"price_position_{n}"] = (n, _position(n))
    for n in (1, 5):
        out[f"intraday_strength_{n}"] = (n, lambda w, n=n: F.avg(F.col("close") / F.nullif("open", F.lit(0.0)) - 1).over(_frame(w, 1 - n)))
    for n in (5, 20):
        out[f"range_volatility_{n}"] = (n, lambda w, n=n: F.avg((F.col("high") - F.col("low")) / F.nullif("close", F.lit(0.0))).over(_frame(w, 1 - n)))
        out[f"illiquidity_{n}"] = (n, lambda w, n=n: F.avg("_illiquid").over(_frame(w, 1 - n)))
    return out


def compute_row_factors(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(symbol, trade_date, close, factor_key, value) over each symbol's own rows; null until there are rows enough.

    bars: symbol, trade_date, open, high, low, close, volume."""
    specs = {k: v for k, v in row_factor_specs().items() if not keys or k in keys}
    w = Window.partitionBy("symbol").orderBy("trade_date")
    base = bars.withColumn("_n", F.row_number().over(w)).withColumn("_previous", F.lag("close", 1).over(w))
    base = base.withColumn("_log", F.ln(F.col("close") / F.nullif("_previous", F.lit(0.0))))
    moved = F.abs(F.col("close") / F.nullif("_previous", F.lit(0.0)) - 1) / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)) * 1e9
    base = base.withColumn("_illiquid", F.coalesce(moved, F.lit(0.0)))
    wide = base.select("symbol", "trade_date", "close", "_n", *(build(w).alias(k) for k, (_, build) in specs.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("factor_key"), F.when(F.col("_n") >= n, F.col(k)).cast("double").alias("value")) for k, (n, _) in specs.items()))
    return wide.select("symbol", "trade_date", "close", F.explode(pairs).alias("p")).select("symbol", "trade_date", "close", "p.factor_key", "p.value")
