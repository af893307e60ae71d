"""Constraints as violation tables, reconciliation, differences, fingerprints, event audits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructType

from tessera.functions.columns import row_checksum

#: Parts of column names that never leave, and the shape of an exact version.
SECRETS = ("path", "secret", "credential", "token", "password", "api_key")
VERSION = r"^[0-9a-f]{64}$"


@dataclass(frozen=True)
class Rule:
    """A code and the condition under which a row breaks it; null means it does not."""

    code: str
    broken: Column


def violations(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(keys, code): a row for each broken rule of each row, in one pass without a shuffle."""
    found = F.filter(F.array(*(F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.code)) for r in rules)), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("code"))


def bar_rules() -> list[Rule]:
    prices = ("open", "high", "low", "close")
    return [
        Rule("price_not_positive", F.least(*prices) <= 0),
        Rule("high_below", F.col("high") < F.greatest("open", "close", "low")),
        Rule("low_above", F.col("low") > F.least("open", "close", "high")),
        Rule("volume_negative", F.col("volume") < 0),
    ]


def prediction_rules(allow_validation: bool = False, holdout_audit: str | None = None) -> list[Rule]:
    """Rules of a prediction ledger's rows."""
    return [
        Rule("role_not_out_of_sample", F.col("split_role") == "train") if allow_validation else Rule("role_not_out_of_sample", F.col("split_role").isin("train", "validation")),
        Rule("holdout_without_audit", (F.col("split_role") == "final_holdout") & F.lit(holdout_audit is None)),
        Rule("fit_cutoff_not_before_decision", F.col("fit_cutoff") >= F.col("decision_time")),
        Rule("available_after_decision", F.col("available_at") > F.col("decision_time")),
        Rule("not_finite", F.col("prediction").isNull() | F.isnan("prediction") | (F.abs("prediction") == float("inf"))),
    ]


#: Columns that name what a prediction was made by; a ledger holds one combination of those it has.
CONTRACT = ("strategy_run", "experiment_id", "model_artifact_version", "feature_artifact_version", "label_version", "target_definition")


def prediction_violations(ledger: DataFrame, universe: DataFrame, listings: DataFrame, allow_validation: bool = False, holdout_audit: str | None = None) -> DataFrame:
    """Row rules, several folds at one decision, two owners of a key, outside the universe or past delisting; one row without keys for several contracts."""
    keys = ["instrument_id", "decision_time"]
    out = violations(ledger, prediction_rules(allow_validation, holdout_audit), keys)
    folds = ledger.groupBy("decision_time").agg(F.count_distinct("fold_id").alias("_n")).where("_n > 1").select(F.lit(None).cast("string").alias("instrument_id"), "decision_time", F.lit("several_folds").alias("code"))
    owners = ledger.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit("several_owners").alias("code"))
    dated = ledger.withColumn("trade_date", F.to_date("decision_time"))
    outside = dated.join(universe.where("eligible").select("instrument_id", "trade_date"), ["instrument_id", "trade_date"], "left_anti").select(*keys, F.lit("outside_universe").alias("code"))
    gone = dated.join(listings.select("instrument_id", "delisting_date"), "instrument_id").where("trade_date > delisting_date").select(*keys, F.lit("delisted").alias("code"))
    found = out.unionByName(folds).unionByName(owners).unionByName(outside).unionByName(gone)
    contract = [c for c in CONTRACT if c in ledger.columns]
    if not contract:
        return found
    made_by = F.struct(*contract)
    mixed = ledger.agg(F.min(made_by).alias("_a"), F.max(made_by).alias("_b")).where(~F.col("_a").eqNullSafe(F.col("_b")))
    return found.unionByName(mixed.select(F.lit(None).cast("string").alias("instrument_id"), F.lit(None).cast(ledger.schema["decision_time"].dataType).alias("decision_time"), F.lit("several_contracts").alias("code")))


def target_violations(targets: DataFrame, session: str, as_of: str) -> DataFrame:
    """Rules of a batch of target rows, and of the batch as a whole (no instrument)."""
    day, now = F.lit(session).cast("date"), F.lit(as_of).cast("timestamp")
    rules = [
        Rule("weight_out_of_range", (F.col("weight") < 0) | (F.col("weight") > 1)),
        Rule("price_not_positive", F.col("price") <= 0),
        Rule("wrong_session", F.col("session") != day),
        Rule("decision_not_before_session", F.to_date("decision_time") >= F.col("session")),
        Rule("available_after_decision", F.col("available_at") > F.col("decision_time")),
        Rule("decision_after_as_of", F.col("decision_time") > now),
        Rule("not_eligible", ~F.col("eligible")),
    ]
    own = violations(targets, rules, ["instrument_id"])
    twice = targets.groupBy("instrument_id").agg(F.count("*").alias("_n")).where("_n > 1").select("instrument_id", F.lit("duplicate").alias("code"))
    whole = targets.agg(F.count_distinct("decision_time").alias("_d"), F.sum("weight").alias("_w"))
    batch = violations(whole.withColumn("instrument_id", F.lit(None).cast("string")), [Rule("several_decision_times", F.col("_d") > 1), Rule("weights_above_one", F.col("_w") > 1 + 1e-9)], ["instrument_id"])
    return own.unionByName(twice).unionByName(batch)


def conformance(panel: DataFrame, max_age_days: int = 3650) -> DataFrame:
    """(instrument_id, session, codes) of each panel row that breaks a data contract.

    panel: instrument_id, session, valid_from, valid_to, announced_at, decision_time, tradable, limit_price, limit_code,
    market_open, benchmark_level, stream_status, entitled_from, entitled_to, received_at, providers_agree, used_fallback, coverage, minimum_coverage."""
    day = F.col("session")
    flags = [
        ("outside_validity", (day < F.col("valid_from")) | (day > F.col("valid_to"))), ("late_announcement", F.col("announced_at") > F.col("decision_time")), ("not_tradable", ~F.col("tradable")),
        ("price_limit_without_code", F.col("limit_price").isNotNull() & F.col("limit_code").isNull()), ("market_closed", ~F.col("market_open")), ("benchmark_missing", F.col("benchmark_level").isNull()),
        ("stream_fault", F.col("stream_status") != "healthy"), ("outside_entitlement", (day < F.col("entitled_from")) | (day > F.col("entitled_to"))), ("retention_exceeded", F.datediff(day, F.to_date("received_at")) > max_age_days),
        ("provider_disagreement", ~F.col("providers_agree")), ("fallback_used", F.col("used_fallback")), ("coverage_below_minimum", F.col("coverage") < F.col("minimum_coverage")),
    ]
    codes = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags)), lambda x: x.isNotNull())
    return panel.select("instrument_id", "session", codes.alias("codes")).where(F.size("codes") > 0)


def redact(df: DataFrame) -> DataFrame:
    """Without columns (and struct fields) whose names tell of secrets; absolute paths in text are replaced."""

    def shown(c: Column, kind, name: str) -> Column | None:
        if any(s in name.lower() for s in SECRETS):
            return None
        if isinstance(kind, StructType):
            inner = [x.alias(f.name) for f in kind.fields if (x := shown(c[f.name], f.dataType, f.name)) is not None]
            return F.when(c.isNotNull(), F.struct(*inner)) if inner else None
        return F.regexp_replace(c, r"(?<![\w/:])/(?:[\w.\-]+/)+[\w.\-]*", "<path>") if isinstance(kind, StringType) else c

    return df.select(*(x.alias(f.name) for f in df.schema.fields if (x := shown(F.col(f"`{f.name}`"), f.dataType, f.name)) is not None))


def require_version(value: str) -> str:
    """An exact version: 64 hex digits, no name that moves."""
    if not re.fullmatch(VERSION, value or ""):
        raise ValueError(f"not an exact version: {value!r}")
    return value


def version_ok(column: Column) -> Column:
    return F.coalesce(column.rlike(VERSION), F.lit(False))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint) of a table's rows in any order; repeated rows count.

    Equal rows are counted first, so a row that repeats is one hash with its count. Hashes are gathered by their first four hex
    digits, sorted and hashed, then by two, then over at most 256 groups: no list holds more than about 1/65,536 of the distinct rows."""
    rows = df.select(row_checksum(*df.columns).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    fine = rows.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string")))), ","), 256).alias("h"))
    mid = fine.groupBy(F.substring("p", 1, 2).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return mid.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


def reconcile(local: DataFrame, remote: DataFrame, keys: list[str], compare: list[str], category: str, critical: bool = True) -> DataFrame:
    """(category, keys, critical, detail): rows one side lacks, and values that differ, nulls being equal."""
    a = local.select(*keys, F.struct(*compare).alias("_a"))
    b = remote.select(*keys, F.struct(*compare).alias("_b"))
    both = a.join(b, keys, "full_outer")
    differ = F.concat_ws(",", *(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in compare))
    detail = F.when(F.col("_a").isNull(), "unknown_locally").when(F.col("_b").isNull(), "missing_remotely").otherwise(F.concat(F.lit("differs:"), differ))
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | (differ != "")).select(F.lit(category).alias("category"), *keys, F.lit(critical).alias("critical"), detail.alias("detail"))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], critical: tuple[str, ...] = ()) -> DataFrame:
    """(keys, change, fields, critical_change): added, removed or changed rows and the fields that changed."""
    fields = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*fields).alias("_a"))
    b = right.select(*keys, F.struct(*fields).alias("_b"))
    changed = lambda names: F.concat_ws(",", *(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in names)) if names else F.lit("")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    both = a.join(b, keys, "full_outer").withColumn("change", kind).withColumn("fields", F.when(F.col("change") == "changed", changed(fields)).otherwise(""))
    return both.where("change != 'changed' or fields != ''").select(*keys, "change", "fields", ((F.col("change") == "changed") & (changed([c for c in fields if c in critical]) != "")).alias("critical_change"))


def metric_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, metric, left, right, difference) of all numeric columns of two runs, side by side."""
    names = [c for c, t in left.dtypes if c != key and t in ("double", "float", "int", "bigint")]
    long = lambda df, out: df.select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(key, names, "metric", out)
    return long(left, "left_value").join(long(right, "right_value"), [key, "metric"], "full_outer").withColumn("difference", F.col("right_value") - F.col("left_value"))


#: The states an order may pass to.
TRANSITIONS = (("O", "F"), ("O", "P"), ("P", "F"), ("O", "O"), ("F", "F"))


def order_audit(events: DataFrame, transitions: tuple[tuple[str, str], ...] = TRANSITIONS) -> DataFrame:
    """(order_id, sequence, code): state changes that are not allowed, gaps in the sequence, event ids that come again, fills above the quantity.

    events: order_id, sequence, state, event_id, filled, quantity. The transition table is a constant, so it is broadcast."""
    w = Window.partitionBy("order_id").orderBy("sequence")
    own = events.withColumn("_was", F.lag("state").over(w)).withColumn("_before", F.lag("sequence").over(w))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in transitions))
    rules = [
        Rule("transition_not_allowed", F.col("_was").isNotNull() & ~F.array_contains(allowed, F.concat_ws(">", "_was", "state"))),
        Rule("sequence_gap", F.col("_before").isNotNull() & (F.col("sequence") != F.col("_before") + 1)),
        Rule("overfilled", F.col("filled") > F.col("quantity")),
    ]
    found = violations(own, rules, ["order_id", "sequence"])
    again = events.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("order_id", "sequence"))).where("_n > 1").select("order_id", "sequence", F.lit("duplicate_event").alias("code"))
    return found.unionByName(again)


def order_states(events: DataFrame) -> DataFrame:
    """The last state of each order."""
    return events.groupBy("order_id").agg(F.max_by("state", "sequence").alias("state"), F.max("sequence").alias("sequence"))


def journal_audit(events: DataFrame, order: tuple[str, ...] = ("intent", "risk", "reserve", "fill"), terminal: str = "run_completed") -> DataFrame:
    """(run_id, sequence, code) of an event journal: gaps, causes that come later or not at all, steps of an order out of turn,
    runs without a last event, reservations that are still active.

    events: run_id, sequence, kind, event_id, causation_id, correlation_id."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    gaps = events.withColumn("_b", F.lag("sequence").over(w)).where("sequence != coalesce(_b, 0) + 1").select("run_id", "sequence", F.lit("sequence_gap").alias("code"))
    causes = events.select("run_id", F.col("event_id").alias("causation_id"), F.col("sequence").alias("_c"))
    loose = events.where("causation_id is not null").join(causes, ["run_id", "causation_id"], "left").where("_c is null or _c >= sequence").select("run_id", "sequence", F.lit("broken_causation").alias("code"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    steps = events.where(F.col("kind").isin(*order)).withColumn("_p", place)
    turn = steps.withColumn("_m", F.max("_p").over(Window.partitionBy("run_id", "correlation_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1))).where("_p < _m").select("run_id", "sequence", F.lit("step_out_of_order").alias("code"))
    ends = events.groupBy("run_id").agg(F.max_by("kind", "sequence").alias("_k"), F.max("sequence").alias("sequence")).where(F.col("_k") != terminal).select("run_id", "sequence", F.lit("missing_terminal_event").alias("code"))
    held = events.groupBy("run_id", "correlation_id").agg(F.max("sequence").alias("sequence"), F.count_if(F.col("kind") == "reserve").alias("_r"), F.count_if(F.col("kind").isin("fill", "release")).alias("_f")).where("_r > _f").select("run_id", "sequence", F.lit("reservation_active").alias("code"))
    return gaps.unionByName(loose).unionByName(turn).unionByName(ends).unionByName(held)


def order_activity(orders: DataFrame, fills: DataFrame, risk: DataFrame) -> DataFrame:
    """One feed of orders, fills and risk decisions: kind, id, occurred_at, detail."""
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "occurred_at", F.col("detail").cast("string").alias("detail"))
    return part(orders, "order").unionByName(part(fills, "fill")).unionByName(part(risk, "risk"))


def page(df: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def best_per_group(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
