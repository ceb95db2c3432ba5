"""Rules read from tables with many rows per rule."""

from pyspark.sql import functions as F

from factweave.operators import generate as G
from factweave.rules import clause, rules_to_df


def test_known_rules_are_written_once_each(spark, tmp_path):
    n = 40
    spark.range(n).select((F.col("id") % 2).alias("k")).write.parquet(str(tmp_path / "t"))
    distinct = spark.read.parquet(str(tmp_path / "t")).distinct()
    literals = rules_to_df(spark, [clause("!P(x,y) v S(x)")]).select("literals").first()[0]
    both = F.array(*[
        F.struct(F.concat(F.lit(l["pred"]), F.col("k").cast("string")).alias("pred"), F.lit(l["positive"]).alias("positive"),
                 F.array(*[F.struct(F.lit(a["kind"]).alias("kind"), F.lit(a["name"]).alias("name")) for a in l["args"]]).alias("args"))
        for l in literals])
    rules = distinct.select("k", both.alias("literals"))
    out = G.new_only(rules, rules.filter("k = 1"))
    assert [r["text"].count("0(") for r in out.collect()] == [2]
    assert "isnotnull(array_min" not in out._jdf.queryExecution().optimizedPlan().toString()
