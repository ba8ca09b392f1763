"""Addresses, names, numbers, flags and statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import close, round_half_even
from .registry import query, read

RAW = "CASE s_suppkey % 4 WHEN 0 THEN '(56438) ' WHEN 1 THEN '  ' ELSE '' END || CASE s_suppkey % 3 WHEN 0 THEN '전라북도 ' WHEN 1 THEN '전북 ' ELSE '전북특별자치도 ' END || CASE s_suppkey % 2 WHEN 0 THEN '고창군 고창읍동리로 ' ELSE '전주시완산구  효자면중앙길 ' END || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN ' (빌딩 2층) ' ELSE '' END || CASE s_suppkey % 3 WHEN 0 THEN ' 고창신협' WHEN 1 THEN ' 새벽' ELSE '' END"
NAME = "CASE s_suppkey % 2 WHEN 0 THEN '새벽점(본관)' ELSE '(' || s_suppkey || ')' END"
SQL_ADDRESS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^\(\d{5}\)\s*', ''), '\s*\([^)]*\)\s*', ' ', 'g'), '^(?:전라북도|전북특별자치도|전북)', '전북특별자치도'), '([가-힣]+[읍면])([가-힣]+(?:로|길|대로))', '\1 \2', 'g'), '\s+', ' ', 'g'))"


def _places(spark, d):
    return read(spark, d, "supplier").selectExpr("s_suppkey", f"{RAW} AS raw", f"{NAME} AS name")


@query(rf"""WITH r AS (SELECT s_suppkey, {RAW} AS raw, {NAME} AS name FROM supplier), n AS (SELECT *, {SQL_ADDRESS} AS address FROM r)
SELECT s_suppkey, address, regexp_replace(regexp_replace(raw, '전라북도|전북특별자치도', '', 'g'), '[^0-9A-Za-z가-힣]', '', 'g') AS compact, CASE WHEN regexp_matches(trim(raw), '^(?:전북특별자치도|전라북도)') THEN trim(raw) ELSE '전북특별자치도 ' || trim(raw) END AS in_province,
coalesce(nullif(trim(regexp_replace(name, '\(.*$', '')), ''), name) AS base_name, regexp_extract(address, '^(.*?(?:로|길)\s*\d+)', 1) AS lead, regexp_extract(address, '(\S+)$', 1) AS last_word, contains(replace(address, ' ', ''), replace('고창읍 동리로', ' ', '')) AS on_road FROM n""")
def addresses_normalised(spark, d):
    """Addresses brought to one form, and what lookups take from them."""
    p = _places(spark, d).withColumn("address", T.address(F.col("raw")))
    a = F.col("address")
    return p.select("s_suppkey", "address", T.compact_address(F.col("raw")).alias("compact"), T.in_province(F.trim("raw")).alias("in_province"), T.base_name(F.col("name")).alias("base_name"), T.road_lead(a).alias("lead"), T.last_word(a).alias("last_word"), T.holds(a, F.lit("고창읍 동리로")).alias("on_road"))


@query(rf"""WITH r AS (SELECT s_suppkey, {RAW} AS raw, {NAME} AS name FROM supplier), n AS (SELECT *, {SQL_ADDRESS} AS address FROM r), w AS (SELECT *, regexp_extract(address, '(\S+)$', 1) AS word FROM n)
SELECT s_suppkey, CASE WHEN word <> '' AND NOT regexp_matches(word, '\d') AND (contains(name, substr(word,1,2)) OR contains(name, word) OR regexp_matches(word, '(신협|금고|은행|우체국|지점|본점)$')) THEN trim(regexp_replace(address, '\S+$', '')) ELSE address END AS address FROM w""")
def institutions_dropped(spark, d):
    """Addresses without an institution's name at the end."""
    p = _places(spark, d).withColumn("address", T.address(F.col("raw")))
    return p.select("s_suppkey", T.without_institution(F.col("address"), F.col("name")).alias("address"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html,'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&amp;','&')) AS plain_md5 FROM pages")
def html_unescaped(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.unescaped(F.col("html"))).alias("plain_md5"))


@query(r"SELECT page_id, i - 1 AS row_no, list_aggregate(list_transform(regexp_extract_all(t, '(?s)<li[^>]*>(.*?)</li>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), 'string_agg', '|') AS cells FROM (SELECT page_id, unnest(rows) AS t, generate_subscripts(rows, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS rows FROM pages))")
def html_rows(spark, d):
    """Rows and cells by their tags (here lists and items), tags dropped and blanks collapsed within cells."""
    rows = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<ul[^>]*>(.*?)</ul>"), F.lit(1))).alias("row_no", "t"))
    cells = F.transform(F.regexp_extract_all("t", F.lit("(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), lambda c: T.collapse(F.regexp_replace(c, "<[^>]*>", " ")))
    return rows.select("page_id", F.col("row_no").cast("long").alias("row_no"), F.when(F.size(cells) > 0, F.array_join(cells, "|")).alias("cells"))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice*l_discount/7.0::DOUBLE)::DOUBLE AS two, printf('%.1f', l_quantity/4.0::DOUBLE)::DOUBLE AS one, printf('%.3f', l_extendedprice/1000.0::DOUBLE)::DOUBLE AS three FROM lineitem")
def rounded_half_even(spark, d):
    """Amounts rounded by their exact binary value, ties to even."""
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", round_half_even(price * F.col("l_discount") / F.lit(7.0), 2).alias("two"), round_half_even(quantity / F.lit(4.0), 1).alias("one"), round_half_even(price / F.lit(1000.0), 3).alias("three"))


@query("SELECT count(*) FILTER (WHERE abs(a+b-c) <= 0.004) AS within, count(*) FILTER (WHERE abs(a+b-c) > 0.004) AS beyond, count(*) FILTER (WHERE NOT rate BETWEEN 0 AND 1) AS bad_rates FROM (SELECT l_extendedprice*l_discount AS a, l_extendedprice*(1-l_discount) AS b, l_extendedprice + CASE WHEN l_orderkey % 10 = 0 THEN 0.01 ELSE 0 END AS c, l_discount AS rate FROM lineitem)")
def component_sums(spark, d):
    """Whether parts add up to their total within a tolerance, and rates stay in bounds."""
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    total = price + F.when(F.col("l_orderkey") % 10 == 0, 0.01).otherwise(0.0)
    rows = read(spark, d, "lineitem").select(close(price * off + price * (1 - off), total, 0.004).alias("ok"), off.between(0, 1).alias("bound"))
    return rows.agg(F.count_if("ok").alias("within"), F.count_if(~F.col("ok")).alias("beyond"), F.count_if(~F.col("bound")).alias("bad_rates"))


@query("SELECT c_custkey, replace(txt, ',', '')::DOUBLE AS amount, coalesce(nullif(trim(phone), ''), 'unknown') AS phone FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey*37 // 1000)::VARCHAR || ',' || lpad((c_custkey*37 % 1000)::VARCHAR, 3, '0') || '.5' END AS txt, CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' ' || c_mktsegment END AS phone FROM customer)")
def parsed_and_defaulted(spark, d):
    """Numbers with separators parsed, blank and null text put by a default."""
    txt = F.expr("CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE concat(cast(c_custkey*37 div 1000 AS string), ',', lpad(cast(c_custkey*37 % 1000 AS string), 3, '0'), '.5') END")
    phone = F.expr("CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat(' ', c_mktsegment) END")
    return read(spark, d, "customer").select("c_custkey", T.number(txt).alias("amount"), T.or_default(phone, F.lit("unknown")).alias("phone"))


@query("SELECT p_partkey, p_retailprice + p_size + p_partkey AS total FROM part")
def wide_sum(spark, d):
    """The sum of all columns whose header starts and whose type fits as asked, the columns taken from the header."""
    part = read(spark, d, "part")
    wanted = [c for c, t in part.dtypes if c.startswith("p_") and t in ("int", "bigint", "double")]
    return part.select("p_partkey", F.aggregate(F.array(*[F.col(c).cast("double") for c in wanted]), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("total"))


@query("SELECT p_partkey, regexp_matches(p_type, '^(STANDARD|SMALL)') AS plain, NOT regexp_matches(p_type, 'TIN$|COPPER$') AS kept, regexp_matches(p_brand, '[13]$') AS cohort, starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2') AS first_brands FROM part")
def pattern_flags(spark, d):
    """Prefixes, suffixes and patterns as flags."""
    return read(spark, d, "part").select("p_partkey", F.col("p_type").rlike("^(STANDARD|SMALL)").alias("plain"), (~F.col("p_type").rlike("TIN$|COPPER$")).alias("kept"), F.col("p_brand").rlike("[13]$").alias("cohort"), (F.startswith("p_brand", F.lit("Brand#1")) | F.startswith("p_brand", F.lit("Brand#2"))).alias("first_brands"))


TAGS = [
    "CASE event_id % 4 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' ELSE 'primary' END AS highway",
    "CASE event_id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'yes' END AS access",
    "CASE event_id % 7 WHEN 0 THEN 'YES' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway",
    "CASE event_id % 11 WHEN 0 THEN 'roundabout' END AS junction",
]


@query(f"""SELECT event_id, CASE WHEN lower(oneway) IN ('-1','reverse') THEN false ELSE true END AS forward, CASE WHEN lower(oneway) IN ('yes','true','1') THEN false WHEN lower(oneway) IN ('-1','reverse','no','false','0') THEN true WHEN junction='roundabout' OR highway IN ('motorway','motorway_link') THEN false ELSE true END AS backward
FROM (SELECT event_id, {', '.join(TAGS)} FROM events) WHERE highway IN ('motorway','motorway_link','primary','residential') AND coalesce(access,'') NOT IN ('no','private')""")
def way_directions(spark, d):
    """Ways that may be driven, by an allow list and a deny list of tags, and the directions they may be driven in."""
    from ..operators.graph import directions, drivable

    tags = read(spark, d, "events").selectExpr("event_id", *TAGS).select("event_id", F.create_map(*[x for c in ("highway", "access", "oneway", "junction") for x in (F.lit(c), F.col(c))]).alias("tags"))
    return tags.where(drivable("tags")).select("event_id", *directions("tags"))


@query("SELECT CASE WHEN city LIKE '전주시%' THEN '전주시' ELSE city END AS city, count(*) AS sites FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN '전주시완산구' WHEN 1 THEN '전주시덕진구' WHEN 2 THEN '군산시' ELSE '고창군' END AS city FROM supplier) GROUP BY 1")
def joint_cities(spark, d):
    city = F.expr("CASE s_suppkey % 4 WHEN 0 THEN '전주시완산구' WHEN 1 THEN '전주시덕진구' WHEN 2 THEN '군산시' ELSE '고창군' END")
    return read(spark, d, "supplier").select(T.joint_city(city).alias("city")).groupBy("city").agg(F.count("*").alias("sites"))


TIERS = ((7000.0, "P1"), (4000.0, "P2"), (-1000.0, "P3"))


@query("SELECT c_custkey, arg_max(tier, bound) AS tier FROM customer JOIN (VALUES " + ",".join(f"({b}::DOUBLE,'{t}')" for b, t in TIERS) + ") t(bound, tier) ON c_acctbal > bound GROUP BY 1")
def tier_table(spark, d):
    """The first tier of a descending table whose bound lies below; a value below all bounds is an error."""
    tiers = F.array(*[F.struct(F.lit(b).alias("bound"), F.lit(t).alias("tier")) for b, t in TIERS])
    first = F.get(F.filter(tiers, lambda t: t["bound"] < F.col("c_acctbal")), F.lit(0))["tier"]
    return read(spark, d, "customer").select("c_custkey", F.coalesce(first, F.raise_error(F.concat(F.lit("no tier for "), F.col("c_acctbal").cast("string"))).cast("string")).alias("tier"))


@query("""WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS med FROM customer WHERE c_nationkey < 20) SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'excluded_route_quality' WHEN c_nationkey >= 20 THEN 'outside_cohort' WHEN c_mktsegment = 'MACHINERY' THEN 'not_adopted' ELSE 'assigned' END AS status,
CASE WHEN c_custkey % 10 > 3 AND c_acctbal >= med THEN 'far_old' WHEN c_custkey % 10 > 3 THEN 'far_young' WHEN c_acctbal >= med THEN 'near_old' ELSE 'near_young' END AS rule_type FROM customer, m""")
def typology_status(spark, d):
    """An ordered status, and a two-by-two rule: strictly beyond a distance, at or above the cohort's median."""
    from ..operators.ranking import exact_quantile

    c = read(spark, d, "customer")
    med = exact_quantile(c.where("c_nationkey < 20"), "c_acctbal", 0.5)
    far, old = F.col("c_custkey") % 10 > 3, F.col("c_acctbal") >= med
    status = F.when(F.col("c_custkey") % 7 == 0, "excluded_route_quality").when(F.col("c_nationkey") >= 20, "outside_cohort").when(F.col("c_mktsegment") == "MACHINERY", "not_adopted").otherwise("assigned")
    return c.select("c_custkey", status.alias("status"), F.when(far & old, "far_old").when(far, "far_young").when(old, "near_old").otherwise("near_young").alias("rule_type"))


@query("SELECT zone, count(n_nationkey) > 0 AS known, count(c_custkey) AS rows_n FROM (SELECT unnest(['ALGERIA','CHINA','ATLANTIS']) AS zone) LEFT JOIN nation ON n_name=zone LEFT JOIN customer ON c_nationkey=n_nationkey GROUP BY 1")
def zone_slice(spark, d):
    """Rows of the zones asked for; a zone that is not known is told apart from one that is empty."""
    asked = spark.createDataFrame([("ALGERIA",), ("CHINA",), ("ATLANTIS",)], "zone string")
    n, c = read(spark, d, "nation"), read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("rows_n"))
    return asked.join(n, F.col("zone") == F.col("n_name"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("zone", F.col("n_nationkey").isNotNull().alias("known"), F.coalesce("rows_n", F.lit(0)).cast("long").alias("rows_n"))


@query(r"SELECT event_id, list_aggregate(list_filter([CASE WHEN NOT regexp_matches(opens, '^([01]\d|2[0-3]):[0-5]\d$') THEN 'time' END, CASE WHEN NOT stops BETWEEN 1 AND 7 THEN 'range' END, CASE WHEN minutes % 5 <> 0 THEN 'step' END, CASE WHEN opens >= closes THEN 'order' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS faults FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '9:00' WHEN 1 THEN '25:10' ELSE '0' || (event_id % 10) || ':30' END AS opens, '08:45' AS closes, event_id % 9 AS stops, event_id % 50 AS minutes FROM events)")
def parameter_checks(spark, d):
    """Faults of scenario parameters: time format, range, step, and one field against another."""
    p = read(spark, d, "events").selectExpr("event_id", "CASE event_id % 6 WHEN 0 THEN '9:00' WHEN 1 THEN '25:10' ELSE concat('0', event_id % 10, ':30') END AS opens", "'08:45' AS closes", "event_id % 9 AS stops", "event_id % 50 AS minutes")
    faults = [F.when(~F.col("opens").rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "time"), F.when(~F.col("stops").between(1, 7), "range"), F.when(F.col("minutes") % 5 != 0, "step"), F.when(F.col("opens") >= F.col("closes"), "order")]
    kept = F.filter(F.array(*faults), lambda x: x.isNotNull())
    return p.select("event_id", F.when(F.size(kept) > 0, F.array_join(kept, ",")).alias("faults"))


@query("SELECT c_custkey, CASE WHEN km <= 1 THEN 'near' WHEN km <= 3 THEN 'walk' WHEN km <= 5 THEN 'ride' ELSE 'far' END AS band, round(sqrt(least(greatest(16.0 + share*(400.0-16.0), 16.0), 400.0)), 4) AS radius, round((lon-127.1)*cos(radians(35.6))*100, 4) AS map_x, round((35.6-lat)*100, 4) AS map_y FROM (SELECT c_custkey, (c_custkey % 80)/10.0::DOUBLE AS km, (c_custkey % 11)/10.0::DOUBLE AS share, 126.3::DOUBLE + (c_custkey % 17)/10.0::DOUBLE AS lon, 35.0::DOUBLE + (c_custkey % 13)/10.0::DOUBLE AS lat FROM customer)")
def map_marks(spark, d):
    """Distance bands, radii whose areas are in proportion, and flat map coordinates."""
    from ..functions.geo import flat

    p = read(spark, d, "customer").selectExpr("c_custkey", "(c_custkey % 80)/10.0D AS km", "(c_custkey % 11)/10.0D AS share", "126.3D + (c_custkey % 17)/10.0D AS lon", "35.0D + (c_custkey % 13)/10.0D AS lat")
    x, y = flat(F.col("lat"), F.col("lon"), 35.6, 127.1, 100.0)
    band = F.when(F.col("km") <= 1, "near").when(F.col("km") <= 3, "walk").when(F.col("km") <= 5, "ride").otherwise("far")
    radius = F.sqrt(F.least(F.greatest(16.0 + F.col("share") * (400.0 - 16.0), F.lit(16.0)), F.lit(400.0)))
    return p.select("c_custkey", band.alias("band"), F.round(radius, 4).alias("radius"), F.round(x, 4).alias("map_x"), F.round(y, 4).alias("map_y"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'excluded' WHEN c_acctbal < 1000 THEN 'not applicable' WHEN v.k IS NOT NULL THEN 'visited' ELSE 'unvisited' END AS visit FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus='P') v ON v.k=c_custkey")
def visit_status(spark, d):
    seen = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    visit = F.when(F.col("c_acctbal") < 0, "excluded").when(F.col("c_acctbal") < 1000, "not applicable").when(F.col("k").isNotNull(), "visited").otherwise("unvisited")
    return read(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", visit.alias("visit"))


@query("SELECT o_orderkey, string_agg(l_linenumber || ':30', ',' ORDER BY l_linenumber) AS candidates, least(7, count(*))::BIGINT AS max_stops FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1")
def scenario_overlay(spark, d):
    """A parameter laid over every candidate of a nested list, and a cap by the list's length."""
    lists = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("int").alias("minutes")))).alias("c"))
    laid = lists.withColumn("c", F.transform("c", lambda x: x.withField("minutes", F.lit(30))))
    return laid.select("o_orderkey", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["id"].cast("string"), x["minutes"].cast("string"))), ",").alias("candidates"), F.least(F.lit(7), F.size("c")).cast("long").alias("max_stops"))


@query("SELECT s_suppkey, CASE WHEN mismatch AND matched = source THEN 'verified_address_boundary_conflict' WHEN mismatch THEN 'source_admin_coordinate_conflict' WHEN matched <> '' AND matched <> coord THEN 'matched_address_admin_conflict' WHEN how = 'name' THEN 'place_name_polygon_validated' ELSE 'polygon_validated' END AS review, CASE WHEN mismatch THEN 'REVIEW' ELSE 'PASS' END AS audit FROM (SELECT *, source <> '' AND coord <> source AS mismatch FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'z' || s_suppkey % 3 END AS source, 'z' || s_suppkey % 2 AS coord, CASE s_suppkey % 5 WHEN 0 THEN '' ELSE 'z' || s_suppkey % 4 END AS matched, CASE WHEN s_suppkey % 7 = 0 THEN 'name' ELSE 'address' END AS how FROM supplier))")
def geocode_reviews(spark, d):
    """Why a located place does or does not agree with its source, and whether it passes the reverse audit."""
    p = read(spark, d, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE concat('z', s_suppkey % 3) END AS source", "concat('z', s_suppkey % 2) AS coord", "CASE s_suppkey % 5 WHEN 0 THEN '' ELSE concat('z', s_suppkey % 4) END AS matched", "CASE WHEN s_suppkey % 7 = 0 THEN 'name' ELSE 'address' END AS how")
    mismatch = (F.col("source") != "") & (F.col("coord") != F.col("source"))
    review = F.when(mismatch & (F.col("matched") == F.col("source")), "verified_address_boundary_conflict").when(mismatch, "source_admin_coordinate_conflict").when((F.col("matched") != "") & (F.col("matched") != F.col("coord")), "matched_address_admin_conflict").when(F.col("how") == "name", "place_name_polygon_validated").otherwise("polygon_validated")
    return p.select("s_suppkey", review.alias("review"), F.when(mismatch, "REVIEW").otherwise("PASS").alias("audit"))


@query("SELECT k, count(*) AS rows_n, sum(n)::BIGINT AS total FROM (SELECT p_brand AS k, 1 AS n FROM part WHERE p_type LIKE '%STANDARD%' UNION ALL SELECT 'group:plain', 1 FROM part WHERE p_type LIKE '%STANDARD%' OR p_type LIKE '%SMALL%') GROUP BY 1")
def brand_and_group(spark, d):
    """A row that holds a keyword counts under its brand and under the keyword's group."""
    plain = reduce(lambda a, b: a | b, (F.contains(F.col("p_type"), F.lit(w)) for w in ("STANDARD", "SMALL")))
    keys = F.filter(F.array(F.when(F.contains(F.col("p_type"), F.lit("STANDARD")), F.col("p_brand")), F.when(plain, F.lit("group:plain"))), lambda x: x.isNotNull())
    return read(spark, d, "part").select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("rows_n"), F.sum(F.lit(1)).alias("total"))


@query("SELECT o_custkey, o_orderpriority, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_key, count(*) - 1 AS duplicates FROM orders GROUP BY 1, 2")
def first_rows(spark, d):
    """The first row, in the source's order, of each composite key, and how many follow."""
    return read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"), (F.count("*") - 1).alias("duplicates"))


@query("SELECT c_mktsegment, min(c_acctbal) AS low, strftime(min(as_of), '%Y-%m-%d') AS as_of, strftime(max(retrieved), '%Y-%m-%d') AS retrieved FROM (SELECT c_mktsegment, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN DATE '2024-01-01' + (c_custkey % 90)::INTEGER END AS as_of, CASE WHEN c_custkey % 4 > 0 THEN DATE '2024-06-01' + (c_custkey % 45)::INTEGER END AS retrieved FROM customer) GROUP BY 1")
def manifest_dates(spark, d):
    """The earliest and latest dates of a manifest's entries, those without a date left aside."""
    c = read(spark, d, "customer").selectExpr("c_mktsegment", "c_acctbal", "CASE WHEN c_custkey % 3 > 0 THEN date_add(DATE '2024-01-01', cast(c_custkey % 90 AS int)) END AS as_of", "CASE WHEN c_custkey % 4 > 0 THEN date_add(DATE '2024-06-01', cast(c_custkey % 45 AS int)) END AS retrieved")
    return c.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), F.date_format(F.min("as_of"), "yyyy-MM-dd").alias("as_of"), F.date_format(F.max("retrieved"), "yyyy-MM-dd").alias("retrieved"))


@query("SELECT key, coalesce(hit, 'null') AS value, hit IS NOT NULL AND known AS cached FROM (SELECT 'address::' || p_brand AS key, min(CASE WHEN p_size % 4 > 0 THEN p_name END) AS hit, bool_or(p_size < 25) AS known FROM part GROUP BY 1)")
def lookup_cache(spark, d):
    """A read-through cache by query key: hits come from it, misses are resolved and kept as null where there is none."""
    part = read(spark, d, "part").withColumn("key", F.concat(F.lit("address::"), "p_brand"))
    service = part.groupBy("key").agg(F.min(F.when(F.col("p_size") % 4 > 0, F.col("p_name"))).alias("hit"))
    cache = part.where("p_size < 25").select("key").distinct().join(service, "key").withColumn("known", F.lit(True))
    asked = part.select("key").distinct().join(cache, "key", "left")
    missed = asked.where("known is null").select("key").join(service, "key", "left").withColumn("known", F.lit(False))
    kept = asked.where("known").select("key", "hit", "known").unionByName(missed)
    return kept.select("key", F.coalesce("hit", F.lit("null")).alias("value"), (F.col("hit").isNotNull() & F.col("known")).alias("cached"))


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 7000) AS p1, count(*) FILTER (WHERE c_acctbal > 4000 AND c_acctbal <= 7000) AS p2, count(*) FILTER (WHERE c_acctbal <= 4000) AS p3 FROM customer GROUP BY 1")
def zone_tier_counts(spark, d):
    """Counts by zone and tier in fixed columns."""
    tier = F.when(F.col("c_acctbal") > 7000, "p1").when(F.col("c_acctbal") > 4000, "p2").otherwise("p3")
    return read(spark, d, "customer").groupBy("c_nationkey").agg(*[F.count_if(tier == t).alias(t) for t in ("p1", "p2", "p3")])


@query("SELECT p_partkey, to_json(struct_pack(id := p_partkey, name := p_name, size := p_size)) AS compact FROM part")
def compact_projection(spark, d):
    """Columns renamed and nested into a compact object."""
    return read(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("compact"))


@query("SELECT o_custkey, string_agg(target, '|' ORDER BY target) AS targets, count(*) AS n FROM (SELECT DISTINCT o_custkey, t.x AS target FROM orders, (SELECT unnest([0,1,2]) AS i) k, LATERAL (SELECT 'T' || ((o_orderkey + i) % 6) AS x) t WHERE i <= o_orderkey % 3) GROUP BY 1")
def stop_targets(spark, d):
    """The targets that a customer's stops serve, each once."""
    serves = F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3), lambda i: F.concat(F.lit("T"), ((F.col("o_orderkey") + i) % 6).cast("string")))
    by = read(spark, d, "orders").select("o_custkey", F.explode(serves).alias("t")).groupBy("o_custkey").agg(F.array_sort(F.collect_set("t")).alias("t"))
    return by.select("o_custkey", F.array_join("t", "|").alias("targets"), F.size("t").cast("long").alias("n"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey=c_nationkey")
def lookup_asserted(spark, d):
    """A lookup that fails where a key has no entry."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    name = F.coalesce("n_name", F.raise_error(F.concat(F.lit("no entry for "), F.col("c_nationkey").cast("string"))).cast("string"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", name.alias("n_name"))


@query("SELECT l_orderkey AS way, string_agg(x, '>' ORDER BY l_linenumber, v) AS path FROM (SELECT l_orderkey, l_linenumber, v, CASE WHEN lag(v) OVER w = v THEN NULL ELSE v::VARCHAR END AS x FROM (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS v FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, v)) GROUP BY 1")
def stitched_paths(spark, d):
    """Legs joined to one path, the vertex where two meet kept once."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 5).alias("v")))), lambda x: x["v"])
    lists = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(v.alias("v"))
    return lists.select("way", F.array_join(F.filter("v", lambda x, i: (i == 0) | (x != F.get("v", i - 1))), ">").alias("path"))
