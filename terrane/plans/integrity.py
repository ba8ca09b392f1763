"""Data-quality checks as rows (check, status, observed, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, read


def check(df: DataFrame, name: str, observed: Column, expected: Column) -> DataFrame:
    """One check over a table: a single row."""
    return df.agg(observed.cast("string").alias("observed"), expected.cast("string").alias("expected")).select(F.lit(name).alias("check"), F.when(F.col("observed") == F.col("expected"), "PASS").otherwise("FAIL").alias("status"), "observed", "expected")


CHECKS = [
    ("customer keys are unique", "SELECT count(DISTINCT c_custkey)::VARCHAR AS observed, count(*)::VARCHAR AS expected FROM customer"),
    ("order prices are not negative", "SELECT (count(*) FILTER (WHERE o_totalprice<0))::VARCHAR, '0' FROM orders"),
    ("segments are known", "SELECT (count(*) FILTER (WHERE c_mktsegment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')))::VARCHAR, '0' FROM customer"),
    ("discounts lie in [0, 1]", "SELECT (count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 1))::VARCHAR, '0' FROM lineitem"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", CASE WHEN observed=expected THEN 'PASS' ELSE 'FAIL' END AS status, observed, expected FROM ({q}) t(observed, expected)" for n, q in CHECKS))
def integrity_checks(spark, d):
    zero = F.lit(0)
    c, o, l_ = (read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    rows = [
        check(c, CHECKS[0][0], F.count_distinct("c_custkey"), F.count("*")),
        check(o, CHECKS[1][0], F.count_if(F.col("o_totalprice") < 0), F.max(zero)),
        check(c, CHECKS[2][0], F.count_if(~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")), F.max(zero)),
        check(l_, CHECKS[3][0], F.count_if(~F.col("l_discount").between(0, 1)), F.max(zero)),
    ]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT count(*) AS missing FROM (SELECT n_nationkey, seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer)")
def matrix_completeness(spark, d):
    """Cells of nation by segment that no customer fills; both sides are fixed small dimensions."""
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).distinct()
    segments = c.agg(F.collect_set("seg").alias("segs"))
    cells = read(spark, d, "nation").select("n_nationkey", F.lit(1).alias("one")).join(segments.withColumn("one", F.lit(1)), "one").select("n_nationkey", F.explode("segs").alias("seg"))
    return cells.join(c, ["n_nationkey", "seg"], "left_anti").agg(F.count("*").alias("missing"))
