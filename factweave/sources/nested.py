"""Nested JSON datasets, scoring logs, inference results and experiment records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DATASET_TYPE = "array<array<map<string,array<array<string>>>>>"
# Fixed markers of a scoring log and the pattern of its file name.
GAIN_SECTION = r"(?s)evaluating gain of candidates\.\.\.(.*?)evaluating gain of candidates took"
GAIN_LINE = r"^\s*([-+]?[0-9.]+(?:[eE][-+]?\d+)?)\s+(.*\S)\s*$"
LOG_NAME = r"temp-(-?\d+)-form-(-?\d+)(-constant)?-output\.log"
RESULT_LINE = r"^\s*([A-Za-z]\w*\(.*\))\s+([-+0-9.,eE]+)\s*$"


def read_fact_json(spark: SparkSession, path) -> DataFrame:
    """``[[fold, ...], [negatives, ...]]`` with ``{relation: [[a, b], ...]}`` per fold to facts.

    Positives come out with truth ``true``, negatives with ``false``.  A file is one JSON value, so
    it is read whole; datasets larger than one document should arrive as several files.
    """
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", DATASET_TYPE).alias("d"))
    return (
        doc.select(F.posexplode("d").alias("part", "folds"))
        .select("part", F.posexplode("folds").alias("fold", "rels"))
        .select("part", "fold", F.explode("rels").alias("pred", "pairs"))
        .select(
            "fold", "pred", F.explode("pairs").alias("args"),
            F.when(F.col("part") == 0, "true").otherwise("false").alias("truth"),
        )
    )


def read_score_logs(spark: SparkSession, path) -> DataFrame:
    """Gains printed by scoring runs: ``template_id, formula_id, with_constants, instance, score``."""
    return score_lines(
        spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    )


def score_lines(logs: DataFrame) -> DataFrame:
    """Gain lines of whole logs (``file, value``); a file may hold several runs."""
    sections = logs.select("file", F.explode(F.regexp_extract_all("value", F.lit(GAIN_SECTION), 1)).alias("part"))
    lines = sections.select("file", F.explode(F.split("part", "\n")).alias("line"))
    return lines.filter(F.col("line").rlike(GAIN_LINE)).select(
        F.regexp_extract("file", LOG_NAME, 1).alias("template_id"),
        F.regexp_extract("file", LOG_NAME, 2).alias("formula_id"),
        (F.regexp_extract("file", LOG_NAME, 3) != "").alias("with_constants"),
        F.regexp_extract("line", GAIN_LINE, 2).alias("instance"),
        F.regexp_extract("line", GAIN_LINE, 1).try_cast("double").alias("score"),
    )


def read_marginals(spark: SparkSession, path) -> DataFrame:
    """``Atom(...) probability`` lines with comma or dot decimals: ``atom, p``."""
    lines = spark.read.text(path).filter(F.col("value").rlike(RESULT_LINE))
    return lines.select(
        F.regexp_replace(F.regexp_extract("value", RESULT_LINE, 1), r"\s", "").alias("atom"),
        F.regexp_replace(F.regexp_extract("value", RESULT_LINE, 2), ",", ".").try_cast("double").alias("p"),
    )


def atom_text(pred: str, cols: list[str]):
    return F.concat(F.lit(pred + "("), F.concat_ws(",", *cols), F.lit(")"))


def write_marginals(marginals: DataFrame, path: str) -> None:
    marginals.select(F.concat_ws(" ", "atom", F.col("p").cast("string")).alias("value")).write.mode("overwrite").text(path)


def true_atoms(marginals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Most probable value per atom: those with p >= 0.5."""
    return marginals.filter(F.col("p") >= threshold).select("atom")


def append_result(df: DataFrame, path: str) -> None:
    """One JSON record per row, added to earlier runs."""
    df.write.mode("append").json(path)
