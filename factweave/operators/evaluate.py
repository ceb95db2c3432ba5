"""Matching predictions to labels and scoring them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.ordering import running_totals


def label_predictions(marginals: DataFrame, positives: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """``atom, p, y``: predictions that are positives (1) or negatives (0).

    Without listed negatives every prediction that is not a positive is a negative.
    """
    pos = positives.select("atom").distinct().withColumn("@pos", F.lit(True))
    out = marginals.join(pos, "atom", "left")
    if negatives is None:
        return out.select(*marginals.columns, F.when(F.col("@pos"), 1).otherwise(0).alias("y"))
    neg = negatives.select("atom").distinct().withColumn("@neg", F.lit(True))
    out = out.join(neg, "atom", "left").filter("`@pos` or `@neg`")
    return out.select(*marginals.columns, F.when(F.col("@pos"), 1).otherwise(0).alias("y"))


def cll(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean log-probability of the label; p = 0 for a positive and p = 1 for a negative are clamped."""
    pos = F.log(F.when(F.col("p") == 0, 1e-6).otherwise(F.col("p")))
    neg = F.log(1 - F.when(F.col("p") == 1, 1 - 1e-6).otherwise(F.col("p")))
    return p.groupBy(*by).agg(F.avg(F.when(F.col("y") == 1, pos).otherwise(neg)).alias("cll"))


def _curve(p: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Points of the threshold sweep: tp, fp within each distinct score and before it."""
    flags = p.select(
        *by, "p", (F.col("y") == 1).cast("bigint").alias("tp"), (F.col("y") != 1).cast("bigint").alias("fp")
    )
    return running_totals(flags, list(by), "p", ["tp", "fp"])


def auc_roc(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count half."""
    c = _curve(p, by)
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2.0))
    return c.groupBy(*by).agg(F.try_divide(area, F.sum("tp") * F.sum("fp").cast("double")).alias("auc_roc"))


def auc_pr(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the precision-recall curve with interpolation between thresholds.

    Between consecutive thresholds false positives grow linearly with true positives (Davis and
    Goadrich, 2006).  With tp = t0 + x and fp = f0 + s x for x in [0, dt], s = df/dt, the precision
    integrates in closed form:
    integral of (t0 + x) / (t0 + f0 + (1 + s) x) dx
    = dt/(1+s) + (t0 - (t0+f0)/(1+s)) / (1+s) * ln((t0 + f0 + (1+s) dt) / (t0 + f0)).
    The segment before the first positive starts at t0 = f0 = 0 unless false positives came first.
    """
    c = _curve(p, by)
    dt, df = F.col("tp").cast("double"), F.col("fp").cast("double")
    t0, f0 = F.col("cum_tp") - dt, F.col("cum_fp") - df
    k = 1 + F.try_divide(df, dt)
    n0 = t0 + f0
    area = F.when(dt == 0, 0.0).when(n0 == 0, F.try_divide(dt, k)).otherwise(
        F.try_divide(dt, k) + F.try_divide(t0 - F.try_divide(n0, k), k) * F.log(F.try_divide(n0 + k * dt, n0))
    )
    return c.groupBy(*by).agg(F.try_divide(F.sum(area), F.sum("tp").cast("double")).alias("auc_pr"))


def cv_report(p: DataFrame, fold: str = "fold") -> DataFrame:
    """``fold, cll, auc_roc, auc_pr`` for every test fold."""
    by = (fold,)
    return cll(p, by).join(auc_roc(p, by), fold).join(auc_pr(p, by), fold)
