"""Areas, outlets and zones out of the driver's tables, with coordinates by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def coords(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return 35.0 + ((k * 7919) % 10000) / 10000.0 * 1.2, 126.3 + ((k * 104729) % 10000) / 10000.0 * 1.6


def areas(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = coords("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"), lat.alias("lat"), lon.alias("lon"))


def outlets(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = coords("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("pzone"), (F.col("s_suppkey") % 4).alias("ptype"), F.col("s_acctbal").alias("pbal"), lat.alias("plat"), lon.alias("plon"))


SQL = """areas AS (SELECT c_custkey AS id, c_nationkey AS zone, c_mktsegment AS segment, c_acctbal AS bal,
  35.0 + ((c_custkey*7919) % 10000)::DOUBLE/10000.0::DOUBLE*1.2::DOUBLE AS lat, 126.3 + ((c_custkey*104729) % 10000)::DOUBLE/10000.0::DOUBLE*1.6::DOUBLE AS lon FROM customer),
outlets AS (SELECT s_suppkey AS pid, s_nationkey AS pzone, s_suppkey % 4 AS ptype, s_acctbal AS pbal,
  35.0 + ((s_suppkey*7919) % 10000)::DOUBLE/10000.0::DOUBLE*1.2::DOUBLE AS plat, 126.3 + ((s_suppkey*104729) % 10000)::DOUBLE/10000.0::DOUBLE*1.6::DOUBLE AS plon FROM supplier),
pairs AS (SELECT *, 2*6371.0088*asin(sqrt(least(1.0, pow(sin((radians(plat)-radians(lat))/2),2)+cos(radians(lat))*cos(radians(plat))*pow(sin((radians(plon)-radians(lon))/2),2)))) AS dist FROM areas, outlets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(dist,6), pid) AS rnk FROM pairs)"""
