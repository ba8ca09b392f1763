"""Plans of all zones brought together, and the quality of tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import routing
from ..sources.tables import staged
from .registry import query, read
from .routes import _sites


@query()
def zone_knapsack(spark, d):
    """Route-days dealt to the zones of each nation: options of none to two days for each zone, most targets first."""
    sites = F.array_sort(F.collect_list(F.struct("id", "x", "y", "tier"))).alias("sites")
    zones = _sites(spark, d).groupBy("zone").agg(sites).select("zone", "sites.id", "sites.x", "sites.y", "sites.tier")

    def options(batches):
        for b in batches:
            yield routing.plane_table(b, 4, 40.0, 45.0)

    found = zones.mapInPandas(options, "zone long, days long, p1 long, p2 long, travel double").withColumn("nation", F.shiftright("zone", 44))
    return routing.deal_groups(staged(found, "options"), "nation", F.expr("zones * 3 div 2")).select("nation", "zone", "days", "p1", "p2", "travel")


@query()
def province_summary(spark, d):
    """Of the exact and the greedy plans of all zones: visits, sites left out, routes, totals and the longest route."""
    sites = staged(_sites(spark, d), "sites")
    plans = staged(routing.solve_zones(sites, vehicles=2, max_stops=4), "plans")
    seen = plans.groupBy("method").agg(F.sum("visits").alias("visits"), F.count("*").alias("routes"), F.round(F.sum("travel"), 3).alias("travel_minutes"), F.round(F.sum("km"), 3).alias("travel_km"), F.max("elapsed").alias("max_elapsed"))
    targets = sites.count() - sites.select("zone").distinct().count()
    return seen.withColumn("unvisited", F.lit(targets) - F.col("visits")).withColumn("all_scheduled", F.col("unvisited") == 0)


@query()
def unvisited_targets(spark, d):
    """Targets that the exact plans leave out, with the reason."""
    sites = staged(_sites(spark, d), "sites")
    plans = routing.solve_zones(sites, vehicles=2, max_stops=4).where("method = 'exact'")
    seen = plans.select(F.explode(F.split("stops", ">")).alias("stop")).select(F.col("stop").cast("long").alias("id"))
    targets = sites.withColumn("nth", F.row_number().over(W.partitionBy("zone").orderBy("id"))).where("nth > 1")
    return targets.join(seen, "id", "left_anti").select("zone", "id", "tier", F.lit("not_selected_under_stop_time_objective").alias("reason"))


@query("SELECT n_regionkey AS region, count(*) AS zones, sum(visits)::BIGINT AS visits, max(longest) AS longest, sum(missing)::BIGINT AS missing FROM (SELECT n_regionkey, n_nationkey, count(c_custkey) FILTER (WHERE c_acctbal>0) AS visits, max(c_acctbal) AS longest, count(c_custkey) FILTER (WHERE c_acctbal<=0) AS missing FROM nation JOIN customer ON c_nationkey=n_nationkey GROUP BY 1,2) GROUP BY 1")
def province_rollup(spark, d):
    """Zones summed up to their province: counts added, the longest kept."""
    zones = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_if(F.col("c_acctbal") > 0).alias("visits"), F.max("c_acctbal").alias("longest"), F.count_if(F.col("c_acctbal") <= 0).alias("missing"))
    return read(spark, d, "nation").join(zones, "n_nationkey").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("zones"), F.sum("visits").alias("visits"), F.max("longest").alias("longest"), F.sum("missing").alias("missing"))


@query("SELECT o_orderkey, ((i-1) // 3 + 1)::BIGINT AS cycle_day, 'vehicle-' || ((i-1) % 3 + 1) AS vehicle FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS i FROM orders)")
def cycle_schedule(spark, d):
    """All routes in order dealt to days and vehicles."""
    from ..operators.ranking import numbered

    o = numbered(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), F.col("o_orderkey"))
    return o.select("o_orderkey", F.expr("nth div 3 + 1").alias("cycle_day"), F.concat(F.lit("vehicle-"), (F.col("nth") % 3 + 1).cast("string")).alias("vehicle"))


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS surplus, (SELECT count(DISTINCT o_custkey) FROM orders) AS rows_n")
def recompute_equals(spark, d):
    """Whether a table worked out anew equals the stored one: rows that either side lacks."""
    work = lambda: read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    stored, again = staged(work(), "stored"), work()
    side = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    rows = stored.agg(F.count("*").alias("rows_n")).withColumn("k", F.lit(1))
    return side(stored, again, "missing").join(side(again, stored, "surplus"), "k").join(rows, "k").drop("k")


FORBIDDEN = ("phone", "email", "address", "resident_id")


@query("SELECT 'customer' AS source, 0::BIGINT AS forbidden_columns, count(*) FILTER (WHERE c_mktsegment IS NULL OR trim(c_mktsegment)='') AS blank_status, false AS population_exposure_valid, false AS operational_ready, 'straight_line' AS distance_model FROM customer")
def measurement_contract(spark, d):
    """Columns that must not be there, statuses left blank, and the flags that bound what the figures may be used for."""
    c = read(spark, d, "customer")
    bad = sum(any(f in name.lower() for f in FORBIDDEN) for name in c.columns)
    blank = F.count_if(F.col("c_mktsegment").isNull() | (F.trim("c_mktsegment") == ""))
    return c.agg(blank.alias("blank_status")).select(F.lit("customer").alias("source"), F.lit(bad).cast("long").alias("forbidden_columns"), "blank_status", F.lit(False).alias("population_exposure_valid"), F.lit(False).alias("operational_ready"), F.lit("straight_line").alias("distance_model"))


@query()
def file_lineage(spark, d):
    """Size and digest of every input file against a manifest of them, one of whose entries is wrong on purpose."""
    from ..sources.tables import hashes, lineage

    found = hashes(spark, f"{d}/region.parquet").unionByName(hashes(spark, f"{d}/nation.parquet"))
    name = F.regexp_extract("path", r"(\w+)\.parquet", 1)
    manifest = found.select(name.alias("name"), "bytes", F.when(name == "nation", F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    return lineage(found.withColumn("name", name), manifest)
