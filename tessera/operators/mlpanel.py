"""Supervised panels, walk-forward folds, fold preprocessing and linear models from Gram sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.evaluation import daily_ic
from tessera.operators.features import FORBIDDEN
from tessera.operators.selection import exact_quantiles, stored


def build_supervised(features: DataFrame, labels: DataFrame, universe: DataFrame, names: list[str], policy: str = "invalid") -> DataFrame:
    """Labels with an ordered vector of features of the same decision time.

    A missing or invalid feature is a null element and the reason missing_or_invalid_feature:<name>; an invalid label
    is invalid_label:<reason>. policy: "invalid" keeps such rows, "drop_sample" drops them."""
    if bad := set(names) & set(FORBIDDEN):
        raise ValueError(f"features may not be {sorted(bad)}")
    wide = features.where(F.col("feature_name").isin(names)).groupBy("instrument_id", "decision_time").agg(*(F.max(F.when((F.col("feature_name") == n) & F.col("valid"), F.col("value"))).alias(f"_f_{n}") for n in names))
    member = universe.where("eligible").select("instrument_id", F.col("trade_date").alias("decision_date"))
    rows = labels.join(member, ["instrument_id", "decision_date"], "left_semi").join(wide, ["instrument_id", "decision_time"], "left")
    reasons = F.filter(F.array(F.when(~F.col("valid"), F.concat(F.lit("invalid_label:"), F.coalesce("invalid_reason", F.lit("")))), *(F.when(F.col(f"_f_{n}").isNull(), F.lit(f"missing_or_invalid_feature:{n}")) for n in names)), lambda x: x.isNotNull())
    out = rows.select("instrument_id", "decision_date", "decision_time", F.array(*(F.col(f"_f_{n}") for n in names)).alias("feature_vector"), F.when(F.col("valid"), F.col("label_value")).alias("label_value"), "label_interval_start", "label_interval_end", (F.size(reasons) == 0).alias("sample_valid"), F.when(F.size(reasons) > 0, F.concat_ws(";", reasons)).alias("sample_reason"))
    return out.where("sample_valid") if policy == "drop_sample" else out


@dataclass(frozen=True)
class FoldConfig:
    """Sessions of each part; train_max None lets training grow; holdout is the last stretch, kept apart."""

    train: int
    validation: int
    test: int
    embargo: int = 0
    step: int | None = None
    holdout: int = 0
    train_max: int | None = None

    def bounds(self, sessions: int) -> list[tuple[int, int, int, int, int, int, int]]:
        """(fold, train first and last, validation first and last, test first and last), sessions from 1."""
        step = self.step or self.validation + self.test
        if step < self.validation + self.test:
            raise ValueError("step is shorter than validation and test")
        out, end = [], self.train
        while end + self.embargo + self.validation + self.embargo + self.test <= sessions - self.holdout:
            first = 1 if self.train_max is None else max(1, end - self.train_max + 1)
            v = end + self.embargo + 1
            t = v + self.validation + self.embargo
            out.append((len(out) + 1, first, end, v, v + self.validation - 1, t, t + self.test - 1))
            end += step
        return out


def walk_forward(samples: DataFrame, sessions: DataFrame, config: FoldConfig) -> DataFrame:
    """(fold_id, role, purged, samples' columns): each sample in all folds it belongs to.

    Training samples whose label interval reaches into the fold's validation or test decisions are purged (flagged).
    The table of folds has a row a fold, made from the number of sessions alone, so it is broadcast."""
    count = sessions.count()
    spark = samples.sparkSession
    folds = spark.createDataFrame(config.bounds(count) or [(0, 0, -1, 0, -1, 0, -1)], "fold_id int, a int, b int, v int, w int, t int, u int")
    held = sessions.agg(F.max("session_idx").alias("_last"))
    placed = samples.join(sessions.select(F.col("trade_date").alias("decision_date"), "session_idx"), "decision_date")
    i = F.col("session_idx")
    role = F.when(i.between(F.col("a"), F.col("b")), "train").when(i.between(F.col("v"), F.col("w")), "validation").when(i.between(F.col("t"), F.col("u")), "test")
    rows = placed.join(F.broadcast(folds), role.isNotNull()).withColumn("role", role)
    # Where the evaluation of each fold begins: a map-side aggregate of a row a fold, so no fold is gathered in one task.
    begins = rows.where(F.col("role") != "train").groupBy("fold_id").agg(F.min("label_interval_start").alias("_start"))
    purged = (F.col("role") == "train") & F.coalesce(F.col("label_interval_end") >= F.col("_start"), F.lit(False))
    out = rows.join(F.broadcast(begins), "fold_id", "left").withColumn("purged", purged).select(*(c for c in rows.columns if c not in ("a", "b", "v", "w", "t", "u")), "purged")
    if not config.holdout:
        return out
    final = placed.join(held, i > F.col("_last") - config.holdout).drop("_last").withColumn("fold_id", F.lit(0)).withColumn("role", F.lit("final_holdout")).withColumn("purged", F.lit(False))
    return out.unionByName(final)


def fold_counts(folds: DataFrame) -> DataFrame:
    """(fold_id, role, n, purged, fit_cutoff): the last decision time that training may have seen."""
    cut = F.max(F.when((F.col("role") == "train") & ~F.col("purged"), F.col("decision_time")))
    return folds.groupBy("fold_id", "role").agg(F.count("*").alias("n"), F.sum(F.col("purged").cast("int")).alias("purged"), cut.alias("fit_cutoff"))


def fit_robust(df: DataFrame, start: str, end: str, value: str = "value", by: str = "feature_name") -> DataFrame:
    """(by, median, mad) over a window of dates; only features whose MAD is above zero."""
    rows = stored(df.where(F.col("decision_date").between(start, end) & F.col(value).isNotNull()).select(by, value))
    middle = stored(exact_quantiles(rows, [by], value, {"median": 0.5}, written=True))
    spread = exact_quantiles(rows.join(middle, by).select(by, F.abs(F.col(value) - F.col("median")).alias("_d")), [by], "_d", {"mad": 0.5}).join(middle, by).select(by, "median", "mad")
    return spread.where("mad > 0")


def apply_robust(df: DataFrame, fitted: DataFrame, value: str = "value", by: str = "feature_name") -> DataFrame:
    return df.join(fitted, by).withColumn("scaled", (F.col(value) - F.col("median")) / F.col("mad"))


def fit_fold_preprocessor(train: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """(fold_id, pos, median, lo, hi, mean, sd) of each element of feature_vector over training rows.

    Nulls take the median, then values are clipped at linear quantiles, then mean and sample deviation (0 counts as 1)."""
    long = stored(train.select("fold_id", F.posexplode("feature_vector").alias("pos", "x")))
    middle = stored(exact_quantiles(long, ["fold_id", "pos"], "x", {"median": 0.5}, written=True))
    filled = long.join(middle, ["fold_id", "pos"]).withColumn("x", F.coalesce("x", "median"))
    bounds = exact_quantiles(filled, ["fold_id", "pos"], "x", {"lo": lower, "hi": upper})
    clipped = filled.join(bounds, ["fold_id", "pos"]).withColumn("x", F.least(F.greatest("x", "lo"), "hi"))
    sd = F.stddev_samp("x")
    return clipped.groupBy("fold_id", "pos").agg(F.max("median").alias("median"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("x").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def apply_preprocessor(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows with `x`, the prepared vector. The parameters have a row a fold after packing, so they are broadcast."""
    packed = fitted.groupBy("fold_id").agg(F.array_sort(F.collect_list(F.struct("pos", "median", "lo", "hi", "mean", "sd"))).alias("_p"))
    made = F.zip_with("feature_vector", "_p", lambda v, p: (F.least(F.greatest(F.coalesce(v, p["median"]), p["lo"]), p["hi"]) - p["mean"]) / p["sd"])
    return rows.join(F.broadcast(packed), "fold_id").withColumn("x", made).drop("_p")


def with_sample_weight(df: DataFrame, policy: str = "equal") -> DataFrame:
    """With `weight`: 1, or by_date: 1 over the rows of the decision date."""
    weight = F.lit(1.0) if policy == "equal" else 1.0 / F.count("*").over(Window.partitionBy("decision_date"))
    return df.withColumn("weight", weight)


def gram(rows: DataFrame, width: int, by: str = "fold_id") -> DataFrame:
    """Weighted sums of all products of x (array), 1 and label_value, one row a fold. Plain sums, combined map-side."""
    cols: list[Column] = [F.lit(1.0), *(F.get("x", F.lit(i)) for i in range(width)), F.col("label_value")]
    sums = [F.sum(F.col("weight") * cols[i] * cols[j]).alias(f"s_{i}_{j}") for i in range(width + 2) for j in range(i, width + 2)]
    return rows.groupBy(by).agg(*sums)


def _matrices(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = width + 2
    full = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            full[i, j] = full[j, i] = row[f"s_{i}_{j}"]
    return full[:-1, :-1], full[:-1, -1]


def solve_ridge(stats: DataFrame, width: int, alpha: float = 0.0, by: str = "fold_id") -> list[tuple]:
    """[(fold, intercept, coefficients)] with an unpenalised intercept; a singular system raises. One small solve a fold."""
    out = []
    for row in stats.collect():
        a, b = _matrices(row, width)
        a = a + np.diag([0.0] + [alpha] * width)
        if np.linalg.matrix_rank(a) < width + 1:
            raise ValueError(f"singular design in {by} {row[by]}")
        w = np.linalg.solve(a, b)
        out.append((row[by], float(w[0]), [float(v) for v in w[1:]]))
    return sorted(out)


def solve_elastic_net(stats: DataFrame, width: int, alpha: float, l1_ratio: float, sweeps: int = 1000, tolerance: float = 1e-10, by: str = "fold_id") -> list[tuple]:
    """[(fold, intercept, coefficients)] by cyclic coordinate descent on the Gram sums; the intercept is the weighted mean of y."""
    out = []
    for row in stats.collect():
        a, b = _matrices(row, width)
        total, mean = a[0, 0], b[0] / a[0, 0]
        g, c = a[1:, 1:] / total, (b[1:] - mean * a[0, 1:]) / total
        w = np.zeros(width)
        for _ in range(sweeps):
            before = w.copy()
            for j in range(width):
                rho = c[j] - g[j] @ w + g[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / (g[j, j] + alpha * (1 - l1_ratio)) if g[j, j] + alpha * (1 - l1_ratio) > 0 else 0.0
            if np.abs(w - before).max() < tolerance:
                break
        out.append((row[by], float(mean), [float(v) for v in w]))
    return sorted(out)


@dataclass(frozen=True)
class Candidate:
    """A model to try: kind is dummy_mean, dummy_zero, ols, ridge or elastic_net; simpler ones have a smaller rank."""

    name: str
    kind: str
    alpha: float = 0.0
    l1_ratio: float = 0.0
    rank: int = 0


GRID = (
    Candidate("dummy_mean", "dummy_mean", rank=0), Candidate("dummy_zero", "dummy_zero", rank=0), Candidate("ols", "ols", rank=1),
    *(Candidate(f"ridge_{a:g}", "ridge", a, rank=2) for a in (0.1, 1.0, 10.0)),
    *(Candidate(f"elastic_{a:g}_{r:g}", "elastic_net", a, r, rank=3) for a in (0.001, 0.01, 0.1) for r in (0.2, 0.8)),
)


def fit_candidates(train: DataFrame, width: int, grid: tuple[Candidate, ...] = GRID) -> list[tuple]:
    """[(fold, candidate, rank, alpha, intercept, coefficients)] from one pass of Gram sums; a candidate that fails is left out."""
    stats = gram(train, width).persist()
    try:
        means = {r["fold_id"]: r["s_0_" + str(width + 1)] / r["s_0_0"] for r in stats.collect()}
        out = []
        for c in grid:
            try:
                if c.kind.startswith("dummy"):
                    fitted = [(f, m if c.kind == "dummy_mean" else 0.0, [0.0] * width) for f, m in means.items()]
                elif c.kind == "elastic_net":
                    fitted = solve_elastic_net(stats, width, c.alpha, c.l1_ratio)
                else:
                    fitted = solve_ridge(stats, width, c.alpha)
            except ValueError:
                continue
            out += [(f, c.name, c.rank, c.alpha, b, w) for f, b, w in fitted]
        return out
    finally:
        stats.unpersist()


def predict(rows: DataFrame, fitted: list[tuple]) -> DataFrame:
    """Rows for each candidate of their fold, with `prediction`. The models (a row a fold and candidate) are broadcast."""
    models = rows.sparkSession.createDataFrame(fitted, "fold_id int, candidate string, rank int, alpha double, intercept double, w array<double>")
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(F.broadcast(models), "fold_id").withColumn("prediction", F.col("intercept") + dot).drop("w", "intercept")


def select_candidates(scored: DataFrame) -> DataFrame:
    """The candidate of each fold with the best mean validation rank IC (rounded to 1e-12); ties to the simpler, then the
    stronger penalty, then the name. Test rows take no part."""
    rows = scored.where("role = 'validation'").withColumn("value", F.round("prediction", 12))
    daily = daily_ic(rows, ["fold_id", "candidate", "rank", "alpha"], 3)
    means = daily.groupBy("fold_id", "candidate", "rank", "alpha").agg(F.round(F.avg("rank_ic"), 12).alias("validation_ic"))
    order = Window.partitionBy("fold_id").orderBy(F.desc_nulls_last("validation_ic"), "rank", F.desc("alpha"), "candidate")
    return means.withColumn("place", F.row_number().over(order))


def fold_stability(metrics: DataFrame, value: str = "mean_rank_ic") -> DataFrame:
    """Mean and deviation of a metric over folds, by role."""
    return metrics.groupBy("split_role").agg(F.count("*").alias("folds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def expanding_regression(df: DataFrame, x: str = "value", y: str = "label_value", lag: int = 2) -> DataFrame:
    """(decision_date, n, intercept, slope): y on x over all sessions at least `lag` before, in closed form from running sums.

    Rows are first summed to one a session, so the single ordered window has a row a session."""
    days = df.groupBy("decision_date").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"))
    w = Window.orderBy("decision_date").rowsBetween(Window.unboundedPreceding, -lag)
    run = days.select("decision_date", *(F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")))
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)))
    return run.where("n >= 2").withColumn("slope", slope).select("decision_date", "n", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "slope")
