"""Text, hash and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, read


@query(r"SELECT doc_id, md5(norm) AS norm_key, length(norm) AS norm_chars FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)', ' ', 'g'), '[^0-9A-Za-z]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM documents)")
def normalize_text_key(spark, d):
    """A key of the whole text, parenthesised parts dropped, runs of other characters as one blank."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\([^)]*\)", " "), "[^0-9A-Za-z]+", " "), " +", " ")
    return read(spark, d, "documents").select("doc_id", F.md5(F.trim(t)).alias("norm_key"), F.char_length(F.trim(t)).cast("long").alias("norm_chars"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\([^)]*\)', ' ', 'g'), '[^0-9A-Za-z]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM documents")
def normalized_text(spark, d):
    """The whole text so normalised; normalize_text_key is its digest."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\([^)]*\)", " "), "[^0-9A-Za-z]+", " "), " +", " ")
    return read(spark, d, "documents").select("doc_id", F.trim(t).alias("norm"))


@query("SELECT s_suppkey, 'TR-' || upper(substr(sha256(s_name || '|' || s_nationkey || '|' || s_suppkey),1,12)) AS stable_id, md5(s_name) AS name_md5 FROM supplier")
def stable_hash_id(spark, d):
    key = F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"))
    return read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("TR-"), F.upper(F.substring(F.sha2(key, 256), 1, 12))).alias("stable_id"), F.md5("s_name").alias("name_md5"))


@query("SELECT event_id, CAST(coalesce(json_extract_string(props,'$.k'), json_extract_string(props,'$.response.k')) AS BIGINT) AS k FROM events")
def json_envelope(spark, d):
    """A value from either of two envelopes."""
    return read(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.response.k")).try_cast("long").alias("k"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_fields(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("WITH v AS (SELECT p_partkey, unnest([p_brand || p_size, p_brand, 'any']) AS key, unnest([1,2,3]) AS ord FROM part), l AS (SELECT p_brand || p_size AS key, min(p_partkey) AS hit FROM part WHERE p_size > 30 GROUP BY 1 UNION ALL SELECT p_brand, max(p_partkey) FROM part WHERE p_size<10 GROUP BY 1 UNION ALL SELECT 'any', 0) SELECT p_partkey, arg_min(hit, ord) AS hit, min(ord)::BIGINT AS method FROM v JOIN l USING (key) GROUP BY 1")
def variant_fallback_lookup(spark, d):
    """Variants of a key tried in order; the first that the lookup has wins."""
    part = read(spark, d, "part")
    both = F.concat("p_brand", F.col("p_size").cast("string"))
    tried = part.select("p_partkey", F.posexplode(F.array(both, "p_brand", F.lit("any"))).alias("ord", "key"))
    lookup = part.where("p_size > 30").groupBy(both.alias("key")).agg(F.min("p_partkey").alias("hit")).union(part.where("p_size < 10").groupBy("p_brand").agg(F.max("p_partkey"))).union(spark.range(1).select(F.lit("any"), F.lit(0).cast("long")))
    return tried.join(lookup, "key").groupBy("p_partkey").agg(F.min_by("hit", "ord").alias("hit"), (F.min("ord") + 1).cast("long").alias("method"))


@query("WITH one AS (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority)=1) SELECT o_orderkey, p AS reused FROM orders LEFT JOIN one USING (o_custkey)")
def unambiguous_reuse(spark, d):
    """A value is reused only where its key has a single one."""
    o = read(spark, d, "orders")
    one = o.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("low"), F.max("o_orderpriority").alias("high")).where("low = high").select("o_custkey", F.col("low").alias("reused"))
    return o.join(one, "o_custkey", "left").select("o_orderkey", "reused")


@query("SELECT event_id, lpad((x//60)::VARCHAR,2,'0') || ':' || lpad((x%60)::VARCHAR,2,'0') AS hhmm, x AS minutes FROM (SELECT event_id, (hour(ts)*60+minute(ts))::BIGINT AS x FROM events)")
def clock_minutes(spark, d):
    x = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    return read(spark, d, "events").select("event_id", x.alias("minutes")).select("event_id", F.concat_ws(":", F.lpad(F.floor(F.col("minutes") / 60).cast("string"), 2, "0"), F.lpad((F.col("minutes") % 60).cast("string"), 2, "0")).alias("hhmm"), "minutes")
