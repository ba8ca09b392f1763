"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clustering import adjusted_rand, best_jaccard, names, profiles, robust_scale, select_model, sensitivity, stability, stability_summary, ward_groups
from .registry import query, read


@query("WITH s AS (SELECT c_nationkey, quantile_cont(c_acctbal,0.5) AS m, quantile_cont(c_acctbal,0.75)-quantile_cont(c_acctbal,0.25) AS r FROM customer GROUP BY 1) SELECT c_custkey, round((c_acctbal-m)/CASE WHEN r>0 THEN r ELSE 1 END,6) AS scaled FROM customer JOIN s USING (c_nationkey)")
def scaled_balances(spark, d):
    return robust_scale(read(spark, d, "customer"), ["c_acctbal"], ["c_nationkey"]).select("c_custkey", F.round("c_acctbal_scaled", 6).alias("scaled"))


CELLS = "c AS (SELECT label AS a, vec_id % 4 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1,2)"


@query(f"WITH {CELLS}, s AS (SELECT sum(n*(n-1)/2) AS s, sum(n)*(sum(n)-1)/2 AS t FROM c), l AS (SELECT sum(n*(n-1)/2) AS l FROM (SELECT sum(n) AS n FROM c GROUP BY a)), r AS (SELECT sum(n*(n-1)/2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((s-l*r/t)/((l+r)/2-l*r/t),9) AS ari FROM s, l, r")
def label_agreement(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 4).alias("b"))
    return adjusted_rand(rows, "a", "b").select(F.round("ari", 9).alias("ari"))


@query(f"WITH {CELLS}, l AS (SELECT a, sum(n) AS na FROM c GROUP BY a), r AS (SELECT b, sum(n) AS nb FROM c GROUP BY b) SELECT a, round(max(n/(na+nb-n)),9) AS jaccard FROM c JOIN l USING (a) JOIN r USING (b) GROUP BY a")
def jaccard_best_match(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 4).alias("b"))
    return best_jaccard(rows, "a", "b").select("a", F.round("jaccard", 9).alias("jaccard"))


@query()
def ward_partition(spark, d):
    """Ward clusters of the suppliers of each nation by balance."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("zone"), F.col("s_suppkey").alias("id"), "s_acctbal")
    return ward_groups(s, "id", "zone", ["s_acctbal"], 3)


@query("WITH m AS (SELECT c_nationkey, count(*) AS members, quantile_cont(c_acctbal,0.5) AS c_acctbal_median FROM customer GROUP BY 1), s AS (SELECT a.c_nationkey, a.c_custkey, round(sum(abs(a.c_acctbal-b.c_acctbal)),6) AS s FROM customer a JOIN customer b ON a.c_nationkey=b.c_nationkey GROUP BY 1,2) SELECT c_nationkey, members, round(c_acctbal_median,4) AS median, arg_min(c_custkey, struct_pack(a := s, b := c_custkey)) AS medoid FROM m JOIN s USING (c_nationkey) GROUP BY 1,2,3")
def cluster_profiles(spark, d):
    """Members, median and medoid of each cluster."""
    told = profiles(read(spark, d, "customer"), "c_custkey", "c_nationkey", ["c_acctbal"])
    return told.select("c_nationkey", "members", F.round("c_acctbal_median", 4).alias("median"), "medoid")


@query("""WITH p AS (SELECT c_nationkey % 5 AS cluster, count(*) AS hub, max(c_acctbal) AS remote, min(c_acctbal) AS aged FROM customer GROUP BY 1), a AS (SELECT arg_max(cluster, struct_pack(x := hub, y := -cluster)) AS c FROM p), b AS (SELECT arg_max(cluster, struct_pack(x := remote, y := -cluster)) AS c FROM p WHERE cluster NOT IN (SELECT c FROM a)),
e AS (SELECT arg_max(cluster, struct_pack(x := aged, y := -cluster)) AS c FROM p WHERE cluster NOT IN (SELECT c FROM a UNION SELECT c FROM b)) SELECT cluster, CASE WHEN cluster=a.c THEN 'hub' WHEN cluster=b.c THEN 'remote' WHEN cluster=e.c THEN 'aged' ELSE 'mixed-' || cluster END AS name FROM p, a, b, e""")
def cluster_names(spark, d):
    """Names by a chain of highest profiles."""
    by = read(spark, d, "customer").groupBy((F.col("c_nationkey") % 5).alias("cluster")).agg(F.count("*").alias("hub"), F.max("c_acctbal").alias("remote"), F.min("c_acctbal").alias("aged"))
    return names(by, "cluster", "hub", "remote", "aged").select("cluster", "name")


@query("WITH g AS (SELECT c_nationkey AS k, avg(c_acctbal) AS s, count(*) > 40 AS a, min(c_acctbal) < 0 AS b FROM customer GROUP BY 1) SELECT arg_max(k, struct_pack(x := round(s,6), y := -k)) AS k, count(*) AS passing FROM g WHERE a AND b")
def gate_select(spark, d):
    """Of the candidates that pass every gate the best."""
    by = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 6).alias("silhouette"), F.array(F.count("*") > 40, F.min("c_acctbal") < 0).alias("gates"))
    return select_model(by)


@query()
def scale_sensitivity(spark, d):
    """Agreement of the suppliers' clusters with those of logarithms of their balances."""
    return sensitivity(read(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], 3)


@query()
def cluster_stability(spark, d):
    """Median and tenth percentile of the agreement of 100 subsamples' clusters, of the nations by customers and balance."""
    by = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("n"), F.avg("c_acctbal").alias("bal")).orderBy("c_nationkey").toPandas()  # 25 rows: a fixed dimension
    x = by[["n", "bal"]].to_numpy(dtype=float)
    return stability_summary(stability(spark, (x - x.mean(0)) / x.std(0), 3))
