"""Reading and writing declarations, facts, rules and listings as text, one item per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.literals import term_text
from ..rules import EQUALS, LITERALS_TYPE

# Fixed line formats.
DECLARATION = r"^\s*([A-Za-z]\w*)\s*\(([^()]*)\)\s*$"
FACT = r"^\s*([!?]?)\s*([A-Za-z]\w*)\s*\((.*)\)\s*$"
COMMENT = r"\s*//.*$"
FOLD_IN_NAME = r"fold-?(\d+)"
RULE_WEIGHT = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s+(.*)$"
_TERM = r'(?:"[^"]*"|[^\s"(),=!]+)'
RULE_LITERAL = rf"^(!?)\s*([A-Za-z]\w*)\s*\(\s*({_TERM}(?:\s*,\s*{_TERM})*)\s*\)$"
EQUALITY = rf"^(!?)\s*({_TERM})\s*(!?=)\s*({_TERM})$"
RULE_SPLIT = r'\s+v\s+(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _lines(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    return raw.withColumn("line", F.trim(F.regexp_replace("raw", COMMENT, ""))).filter("line != ''")


def _arguments(inner: Column) -> Column:
    """Comma-separated arguments; commas inside double quotes do not split."""
    parts = F.split(inner, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda a: F.regexp_replace(F.trim(a), '^"|"$', ""))


def read_schema(spark: SparkSession, path) -> DataFrame:
    """``Name(type1,+type2,type3!)`` lines to ``pred, arg_pos, type, as_constant, exclusive``."""
    m = _lines(spark, path).filter(F.col("line").rlike(DECLARATION)).select(
        F.regexp_extract("line", DECLARATION, 1).alias("pred"),
        F.posexplode(F.split(F.regexp_extract("line", DECLARATION, 2), ",")).alias("arg_pos", "t"),
    )
    return m.select(
        "pred", "arg_pos", F.regexp_replace("t", r"[+!\s]", "").alias("type"),
        F.contains("t", F.lit("+")).alias("as_constant"), F.contains("t", F.lit("!")).alias("exclusive"),
    )


def read_facts(spark: SparkSession, path, schema: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fact lines to ``fold, pred, args, truth`` plus a table of rejected lines with the reason.

    ``Name(a,b)`` is true, ``!Name(a,b)`` false and ``? Name(a,b)`` unknown; ``//`` starts a comment.
    The fold comes from the file name (``...fold3.db`` is fold 3), 0 otherwise.
    """
    fold = F.coalesce(F.regexp_extract("file", FOLD_IN_NAME, 1).try_cast("int"), F.lit(0))
    parsed = _lines(spark, path).select(
        "raw",
        fold.alias("fold"),
        F.col("line").rlike(FACT).alias("ok"),
        F.regexp_extract("line", FACT, 2).alias("pred"),
        _arguments(F.regexp_extract("line", FACT, 3)).alias("args"),
        F.regexp_extract("line", FACT, 1).alias("mark"),
    )
    reason = F.when(~F.col("ok"), "not a fact")
    if schema is not None:
        arity = schema.groupBy("pred").agg(F.count(F.lit(1)).alias("arity"))
        parsed = parsed.join(arity, "pred", "left")
        reason = reason.when(F.col("arity").isNull(), "undeclared predicate").when(
            F.col("arity") != F.size("args"), "wrong number of arguments"
        )
    parsed = parsed.withColumn("reason", reason)
    truth = F.when(F.col("mark") == "!", "false").when(F.col("mark") == "?", "unknown").otherwise("true")
    good = parsed.filter("reason is null").select("fold", "pred", "args", truth.alias("truth"))
    return good, parsed.filter("reason is not null").select("fold", "raw", "reason")


def fact_text() -> Column:
    mark = F.when(F.col("truth") == "false", "!").when(F.col("truth") == "unknown", "? ").otherwise("")
    quoted = F.transform(
        "args", lambda a: F.when(a.rlike(r"^\w+$"), a).otherwise(F.concat(F.lit('"'), a, F.lit('"')))
    )
    return F.concat(mark, F.col("pred"), F.lit("("), F.array_join(quoted, ","), F.lit(")"))


def write_facts(facts: DataFrame, path: str) -> None:
    """One directory per fold, one fact per line."""
    facts.select("fold", fact_text().alias("value")).write.mode("overwrite").partitionBy("fold").text(path)


def rule_literals(body: Column) -> Column:
    """``A(x,Y) v !B(x,z)`` to literal structs; lower-case arguments are variables."""

    def arg(a: Column) -> Column:
        a = F.trim(a)
        is_var = a.rlike("^[a-z]")
        return F.struct(
            F.when(is_var, "var").otherwise("const").alias("kind"), F.regexp_replace(a, '^"|"$', "").alias("name")
        )

    def literal(t: Column) -> Column:
        t = F.trim(t)
        args = F.split(F.regexp_extract(t, RULE_LITERAL, 3), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        plain = F.struct(
            F.regexp_extract(t, RULE_LITERAL, 2).alias("pred"),
            (F.regexp_extract(t, RULE_LITERAL, 1) == "").alias("positive"),
            F.transform(args, arg).alias("args"),
        )
        sides = F.array(F.regexp_extract(t, EQUALITY, 2), F.regexp_extract(t, EQUALITY, 4))
        equality = F.struct(
            F.lit(EQUALS).alias("pred"),
            ((F.regexp_extract(t, EQUALITY, 3) == "=") == (F.regexp_extract(t, EQUALITY, 1) == "")).alias("positive"),
            F.transform(sides, arg).alias("args"),
        )
        return F.when(t.rlike(EQUALITY), equality).otherwise(plain)

    return F.transform(F.split(body, RULE_SPLIT), literal).cast(LITERALS_TYPE)


def read_rules(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Weighted rules ``w  A(x) v !B(x,y)`` and hard rules ending in a full stop, and a table of rejected lines.

    Weights of rules that share a formula are split by the reader of the theory; here each line is
    its own formula.  Declarations and comments are skipped; any other line is rejected with the reason.
    """
    lines = _lines(spark, path).filter(~F.col("line").rlike(DECLARATION) | F.col("line").rlike(RULE_WEIGHT))
    hard = F.col("line").endswith(".") & ~F.col("line").rlike(RULE_WEIGHT)
    soft = F.col("line").rlike(RULE_WEIGHT)
    rows = lines.select(
        "raw", (soft | hard).alias("marked"),
        F.when(soft, F.regexp_extract("line", RULE_WEIGHT, 1).try_cast("double")).otherwise(0.0).alias("weight"),
        F.when(soft, F.lit(False)).otherwise(True).alias("hard"),
        F.when(soft, F.regexp_extract("line", RULE_WEIGHT, 2))
        .otherwise(F.regexp_replace("line", r"\.\s*$", "")).alias("text"),
    )
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    written = F.forall(F.split(text, RULE_SPLIT), lambda t: F.trim(t).rlike(RULE_LITERAL) | F.trim(t).rlike(EQUALITY))
    reason = F.when(~F.col("marked"), "neither a weight nor a full stop").when(~written, "not a rule")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").select(
        text.alias("clause_id"), text.alias("formula_id"), "weight", "hard", rule_literals(text).alias("literals")
    )
    return good, rows.filter("reason is not null").select("raw", "reason")


def split_formula_weights(clauses: DataFrame) -> DataFrame:
    """Clauses of one formula share its weight evenly."""
    n = clauses.groupBy("formula_id").agg(F.count(F.lit(1)).alias("parts"))
    return clauses.join(n, "formula_id").withColumn("weight", F.col("weight") / F.col("parts")).drop("parts")


def literals_text(literals: Column) -> Column:
    def one(l: Column) -> Column:
        args = F.transform(l["args"], term_text)
        sign = F.when(l["positive"], "").otherwise("!")
        return F.when(
            l["pred"] == EQUALS, F.concat(sign, F.array_join(args, " = "))
        ).otherwise(F.concat(sign, l["pred"], F.lit("("), F.array_join(args, ","), F.lit(")")))

    return F.array_join(F.transform(literals, one), " v ")


def write_rules(clauses: DataFrame, path: str) -> None:
    body = literals_text(F.col("literals"))
    line = F.when(F.col("hard"), F.concat(body, F.lit("."))).otherwise(
        F.concat(F.col("weight").cast("string"), F.lit("  "), body)
    )
    clauses.select(line.alias("value")).write.mode("overwrite").text(path)


def strip_markers(lines: DataFrame, col: str = "value") -> DataFrame:
    """Remove ``+`` argument markers from declaration lines of a learned model."""
    text = F.col(col)
    return lines.withColumn(
        col, F.when(text.rlike(DECLARATION), F.regexp_replace(text, r"\+", "")).otherwise(text)
    )


def write_listing(df: DataFrame, path: str) -> None:
    df.select("id", "text").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_listing(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").schema("id string, text string").csv(path)


def declaration_text(schema_df: DataFrame) -> DataFrame:
    """``pred, text``: each declaration as it is written in a file."""
    arg = F.concat(
        F.when(F.col("as_constant"), "+").otherwise(""), F.col("type"), F.when(F.col("exclusive"), "!").otherwise("")
    )
    args = F.transform(
        F.array_sort(F.collect_list(F.struct("arg_pos", arg.alias("t")))), lambda a: a["t"]
    )
    return schema_df.groupBy("pred").agg(args.alias("args")).select(
        "pred", F.concat("pred", F.lit("("), F.array_join("args", ","), F.lit(")")).alias("text")
    )
