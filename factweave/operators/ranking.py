"""Scores of templates, formulas and instances: averaging, normalising, merging, ranking, reports.

A ranking is one flat table ``template_id, with_constants, formula_id, instance, score``; its levels
are grouping keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..facts import union_all
from ..plans.ordering import ordered_positions

TEMPLATE_KEY = ["template_id", "with_constants"]
FORMULA_KEY = TEMPLATE_KEY + ["formula_id"]


def score_formulas(r: DataFrame) -> DataFrame:
    """Mean of gain * multiplier over the instances of each formula."""
    m = F.coalesce("multiplier", F.lit(1.0)) if "multiplier" in r.columns else F.lit(1.0)
    return r.groupBy(*FORMULA_KEY).agg(F.avg(F.col("score") * m).alias("score"))


def score_templates(r: DataFrame) -> DataFrame:
    """Mean over formulas of the formula means."""
    return score_formulas(r).groupBy(*TEMPLATE_KEY).agg(F.avg("score").alias("score"))


def normalise_scores(r: DataFrame) -> DataFrame:
    """All instance scores to [0, 1] by the global minimum and maximum; a zero range gives null."""
    span = r.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return (
        r.join(F.broadcast(span))
        .withColumn("score", F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")))
        .drop("lo", "hi")
    )


def merge_rankings(target: DataFrame, source: DataFrame, op: str = "multiply") -> DataFrame:
    """Combine target instance scores with the source score of the same template.

    ``multiply`` scales by the source template score, ``maximum`` and ``average`` combine the two;
    templates unknown to the source keep their score.
    """
    s = score_templates(source).withColumnRenamed("score", "source_score")
    t, o = F.col("score"), F.col("source_score")
    merged = {"multiply": t * o, "maximum": F.greatest(t, o), "average": (t + o) / 2}[op]
    return target.join(s, TEMPLATE_KEY, "left").withColumn(
        "score", F.when(o.isNull(), t).otherwise(merged)
    ).drop("source_score")


def filter_kind(r: DataFrame, kind: str = "all") -> DataFrame:
    """``all``, ``constants`` (formulas with bound constants) or ``variables``."""
    if kind == "all":
        return r
    return r.filter(F.col("with_constants") if kind == "constants" else ~F.col("with_constants"))


def rank(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of scored rules, best first, equal scores in key order."""
    return ordered_positions(df, [F.col("score").desc(), *[F.col(k) for k in keys]], "rank")


def ranked_formulas(r: DataFrame, kind: str = "all") -> DataFrame:
    """Formulas of the wanted kind, best first."""
    return rank(score_formulas(filter_kind(r, kind)), FORMULA_KEY)


def ranking_report(r: DataFrame) -> DataFrame:
    """Report lines: templates, formulas and instances, each best first, scores with three decimals."""
    def lines(df, level, text, keys):
        ranked = rank(df, keys)
        return ranked.select(
            F.lit(level).alias("level"), "rank", F.concat(F.format_string("%.3f", "score"), F.lit("\t"), text).alias("line")
        )

    t = lines(score_templates(r), "template", F.col("template_id"), TEMPLATE_KEY)
    f = lines(score_formulas(r), "formula", F.col("formula_id"), FORMULA_KEY)
    i = lines(r, "instance", F.col("instance"), FORMULA_KEY + ["instance"])
    return union_all([t, f, i])


def write_ranking_report(r: DataFrame, path: str) -> None:
    order = F.when(F.col("level") == "template", 0).when(F.col("level") == "formula", 1).otherwise(2)
    ranking_report(r).repartitionByRange(order, "rank").sortWithinPartitions(order, "rank").select(
        F.concat_ws("\t", "level", "line").alias("value")
    ).write.mode("overwrite").text(path)


def beam(r: DataFrame, k: int, min_gain: float = 0.0, min_weight: float = 0.0) -> DataFrame:
    """Best k candidates whose gain and weight pass the thresholds."""
    ok = (F.col("gain") > min_gain) & (F.abs("weight") >= min_weight)
    return r.filter(ok).orderBy(F.col("gain").desc(), "clause_id").limit(k)


def last_model(models: DataFrame, run: str = "run", number: str = "number", model: str = "model") -> DataFrame:
    """Highest-numbered model of each run."""
    return models.groupBy(run).agg(F.max_by(model, number).alias(model), F.max(number).alias(number))
