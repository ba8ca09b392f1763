"""Joins, sums and rankings over the sales tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, read

TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey")
def lookup_join_total(spark, d):
    """Two lookups in a row; small dimensions are broadcast by their size alone."""
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')")
def semi_targets(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS only_orders, count(*) FILTER (WHERE o_custkey IS NULL) AS only_customers, count(*) FILTER (WHERE c_custkey=o_custkey) AS both_sides FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey=o_custkey")
def keyset_equality(spark, d):
    """Key sets compared by one full join of distinct keys."""
    both = read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "full")
    return both.agg(F.count_if(F.col("c_custkey").isNull()).alias("only_orders"), F.count_if(F.col("o_custkey").isNull()).alias("only_customers"), F.count_if(F.col("c_custkey") == F.col("o_custkey")).alias("both_sides"))


@query("SELECT p_partkey, coalesce(fixed, p_type) AS p_type, fixed IS NOT NULL AS corrected FROM part LEFT JOIN (SELECT DISTINCT p_brand AS b, p_size AS s, 'FIXED ' || p_brand AS fixed FROM part WHERE p_size % 7 = 0) ON b=p_brand AND s=p_size")
def ledger_override(spark, d):
    """Corrections of a ledger, by a key of two columns, put over the source."""
    part = read(spark, d, "part")
    ledger = part.where("p_size % 7 = 0").select("p_brand", "p_size", F.concat(F.lit("FIXED "), "p_brand").alias("fixed")).distinct()
    return part.join(ledger, ["p_brand", "p_size"], "left").select("p_partkey", F.coalesce("fixed", "p_type").alias("p_type"), F.col("fixed").isNotNull().alias("corrected"))


@query("SELECT kind, name, min(id) AS first_id, count(*) - 1 AS duplicates FROM (SELECT 'customer' AS kind, c_mktsegment AS name, c_custkey AS id FROM customer UNION ALL SELECT 'part', p_brand, p_partkey FROM part UNION ALL SELECT 'nation', n_name, n_nationkey::BIGINT FROM nation) GROUP BY 1,2")
def union_sources_dedup(spark, d):
    """Sources of different shape brought to one, the first row of each key kept and the others counted."""
    pick = lambda t, kind, name, key: read(spark, d, t).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(key).cast("long").alias("id"))
    rows = pick("customer", "customer", "c_mktsegment", "c_custkey").unionByName(pick("part", "part", "p_brand", "p_partkey")).unionByName(pick("nation", "nation", "n_name", "n_nationkey"))
    return rows.groupBy("kind", "name").agg(F.min("id").alias("first_id"), (F.count("*") - 1).alias("duplicates"))


@query("SELECT event_id, list_aggregate(list_sort(list_filter([CASE WHEN value>80 THEN 'high' END, CASE WHEN event_type='error' THEN 'error' END, CASE WHEN user_id%10=0 THEN 'watched' END], lambda x: x IS NOT NULL)), 'string_agg', ' | ') AS reasons FROM events WHERE coalesce(value>80, false) OR event_type='error' OR user_id%10=0")
def reason_tags(spark, d):
    """Rows with at least one reason, with all their reasons."""
    tags = F.array(F.when(F.col("value") > 80, "high"), F.when(F.col("event_type") == "error", "error"), F.when(F.col("user_id") % 10 == 0, "watched"))
    return read(spark, d, "events").select("event_id", F.array_sort(F.filter(tags, lambda x: x.isNotNull())).alias("t")).where("size(t) > 0").select("event_id", F.array_join("t", " | ").alias("reasons"))


@query("SELECT event_type, user_id % 5 AS stratum, min(event_id) AS event_id FROM events GROUP BY 1,2")
def stratified_pick(spark, d):
    return read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("stratum")).agg(F.min("event_id").alias("event_id"))


@query("SELECT p_brand, p_size, count(*) AS rows_n, count(DISTINCT p_name) AS names_n FROM part GROUP BY 1,2 HAVING count(DISTINCT p_name) > 1")
def same_key_diff_name(spark, d):
    return read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("rows_n"), F.count_distinct("p_name").alias("names_n")).where("names_n > 1")


@query("SELECT n_name, " + ", ".join(f"count(event_id) FILTER (WHERE event_type='{t}') AS n_{t}" for t in TYPES) + ", count(event_id) AS total FROM nation LEFT JOIN events ON user_id % 30 = n_nationkey GROUP BY 1")
def coverage_pivot(spark, d):
    """Counts by group and type in fixed columns; groups without rows stay."""
    by = read(spark, d, "events").groupBy((F.col("user_id") % 30).alias("k"), "event_type").count().groupBy("k").pivot("event_type", list(TYPES)).sum("count")
    n = read(spark, d, "nation").join(by, F.col("n_nationkey") == F.col("k"), "left").na.fill(0)
    return n.select("n_name", *[F.col(t).alias(f"n_{t}") for t in TYPES], sum(F.col(t) for t in TYPES).alias("total"))


@query("SELECT tag, count(*) AS parts, count(DISTINCT p_brand) AS brands FROM part, (SELECT unnest(['a','e','i','o','st','re']) AS tag) WHERE contains(lower(p_name), tag) GROUP BY tag")
def keyword_multilabel(spark, d):
    """A row counts under every keyword that it holds; keywords are unfolded within the row."""
    tags = F.filter(F.array(*[F.lit(t) for t in ("a", "e", "i", "o", "st", "re")]), lambda t: F.contains(F.lower("p_name"), t))
    return read(spark, d, "part").select("p_brand", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"))


@query("WITH t AS (SELECT n_nationkey, n_regionkey, coalesce(sum(c_acctbal),0) AS bal, count(c_custkey) FILTER (WHERE c_mktsegment='BUILDING') > 0 AS has FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey GROUP BY 1,2) SELECT n_regionkey, round(coalesce(avg(bal) FILTER (WHERE has),0),2) AS mean_present, round(coalesce(avg(bal) FILTER (WHERE NOT has),0),2) AS mean_absent, count(*) FILTER (WHERE NOT has) AS absent FROM t GROUP BY 1")
def gap_means(spark, d):
    """Means where something is present and where it is not; the mean of none is 0."""
    by = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("bal"), (F.count_if(F.col("c_mktsegment") == "BUILDING") > 0).alias("has"))
    t = read(spark, d, "nation").join(by, "n_nationkey", "left").select("n_regionkey", F.coalesce("bal", F.lit(0.0)).alias("bal"), F.coalesce("has", F.lit(False)).alias("has"))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("bal"))), F.lit(0.0)), 2)
    return t.groupBy("n_regionkey").agg(mean(F.col("has")).alias("mean_present"), mean(~F.col("has")).alias("mean_absent"), F.count_if(~F.col("has")).alias("absent"))


@query("SELECT l_returnflag, min(l_quantity) AS lowest, round(quantile_cont(l_quantity,0.5),4) AS median, round(quantile_cont(l_quantity,0.9),4) AS p90, max(l_quantity) AS highest FROM lineitem GROUP BY 1")
def quantiles_exact(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("lowest"), F.round(F.percentile("l_quantity", 0.5), 4).alias("median"), F.round(F.percentile("l_quantity", 0.9), 4).alias("p90"), F.max("l_quantity").alias("highest"))


@query("SELECT o_custkey, x AS upper_median FROM (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i = n // 2 + 1")
def upper_median(spark, d):
    """The element in the middle of each group, the upper of two."""
    w = W.partitionBy("o_custkey")
    rows = read(spark, d, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")).alias("i"), F.count("*").over(w).alias("n"))
    return rows.where("i = n div 2 + 1").select("o_custkey", F.col("o_totalprice").alias("upper_median"))


@query("SELECT c_nationkey, arg_max(c_custkey, struct_pack(a := c_acctbal, b := -c_custkey)) AS c_custkey, max(c_acctbal) AS bal FROM customer GROUP BY 1")
def argmax_row(spark, d):
    return read(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("c_custkey"), F.max("c_acctbal").alias("bal"))


@query("SELECT o_orderstatus, count(*) AS orders_n, bool_and(o_totalprice>0) AS all_positive, bool_or(o_totalprice>400000) AS any_large, count(*) FILTER (WHERE (o_orderstatus='F') <> (o_orderdate < TIMESTAMP '1995-06-17')) AS inconsistent FROM orders GROUP BY 1")
def flag_consistency(spark, d):
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders_n"), F.every(F.col("o_totalprice") > 0).alias("all_positive"), F.some(F.col("o_totalprice") > 400000).alias("any_large"), F.count_if((F.col("o_orderstatus") == "F") != (F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp"))).alias("inconsistent"))


@query("SELECT o_orderkey, (i-1)//3 + 1 AS day, (i-1)%3 + 1 AS vehicle FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS i FROM orders)")
def round_robin_schedule(spark, d):
    i = F.row_number().over(W.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")).cast("long")
    return read(spark, d, "orders").select("o_orderkey", i.alias("i")).selectExpr("o_orderkey", "(i-1) div 3 + 1 AS day", "(i-1) % 3 + 1 AS vehicle")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def ranked_page(spark, d):
    """The second page of twenty of a ranking."""
    return read(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(20).limit(20)


@query("SELECT o_custkey, sum(o_totalprice) AS total, round(100.0*sum(o_totalprice) FILTER (WHERE o_orderstatus='F')/sum(o_totalprice),1) AS pct_f, CASE WHEN count(*)>1 THEN round(10000.0*count(*) FILTER (WHERE o_orderpriority LIKE '1%')/count(*),1) END AS urgent_per_10k FROM orders GROUP BY 1")
def guarded_ratios(spark, d):
    n = F.count("*")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.round(100.0 * F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / F.sum("o_totalprice"), 1).alias("pct_f"), F.when(n > 1, F.round(10000.0 * F.count_if(F.col("o_orderpriority").startswith("1")) / n, 1)).alias("urgent_per_10k"))


@query("SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE c_acctbal>3000) AS over_3, count(*) FILTER (WHERE c_acctbal>5000) AS over_5, count(*) FILTER (WHERE c_acctbal>3000) - count(*) FILTER (WHERE c_acctbal>5000) AS watch FROM customer GROUP BY 1")
def kpi_panel(spark, d):
    over = lambda x: F.count_if(F.col("c_acctbal") > x)
    return read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total"), over(3000).alias("over_3"), over(5000).alias("over_5"), (over(3000) - over(5000)).alias("watch"))


@query("SELECT p_partkey, CASE WHEN p_size>40 THEN 'P1' WHEN p_size>20 THEN 'P2' WHEN p_retailprice>1200 THEN 'deferred' ELSE 'accessible' END AS priority, list_aggregate(list_filter(['BRASS','STEEL','TIN'], lambda x: contains(p_type,x)), 'first') AS first_match FROM part")
def status_case(spark, d):
    """An ordered choice of status, and the first of a list that the text holds."""
    first = F.get(F.filter(F.array(*[F.lit(x) for x in ("BRASS", "STEEL", "TIN")]), lambda x: F.contains(F.col("p_type"), x)), F.lit(0))
    status = F.when(F.col("p_size") > 40, "P1").when(F.col("p_size") > 20, "P2").when(F.col("p_retailprice") > 1200, "deferred").otherwise("accessible")
    return read(spark, d, "part").select("p_partkey", status.alias("priority"), first.alias("first_match"))
