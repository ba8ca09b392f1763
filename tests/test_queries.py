"""Spark against DuckDB on the smallest tables, and small operators against brute force."""

import glob
import heapq
import itertools
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from terrane.functions import geo, numbers
from terrane.operators import clustering, graph, polygons, ranking, routing, spatial
from terrane.plans import access, graphs, registry, routes
from terrane.sources import tables

DATA = "/root/testdata/sf0.001"
QUICK = ["radius_counts", "outside_bbox", "knn_in_key", "depot_select", "point_in_polygon", "lookup_join_total", "keyset_equality", "ledger_override", "reason_tags", "coverage_pivot", "keyword_multilabel", "gap_means", "upper_median", "status_case", "round_robin_schedule", "adjacency_lists", "integrity_checks", "normalize_text_key", "variant_fallback_lookup", "scaled_balances", "label_agreement", "quality_split"]
QUICK += ["addresses_normalised", "institutions_dropped", "html_unescaped", "html_rows", "rounded_half_even", "component_sums", "parsed_and_defaulted", "wide_sum", "pattern_flags", "way_directions", "joint_cities", "tier_table", "typology_status", "zone_slice", "parameter_checks", "visit_status", "scenario_overlay", "geocode_reviews", "brand_and_group", "first_rows", "manifest_dates", "lookup_cache", "zone_tier_counts", "stop_targets", "lookup_asserted", "stitched_paths", "snap_to_node", "path_reconstruct", "sequential_ids", "even_sample", "route_fold", "cluster_profiles", "cluster_names", "gate_select", "polygon_layers", "outer_rings", "province_rollup", "cycle_schedule", "recompute_equals", "measurement_contract"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, oracle, name):
    df, want = registry.QUERIES[name](spark, DATA), oracle.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    of = lambda rows, names: sorted(str([r[names.index(c)] for c in columns]) for r in rows)
    assert of(df.collect(), df.columns) == of(want.fetchall(), want.columns)


def zone(rng, n, stops):
    km = [[0.0 if i == j else float(rng.randint(1, 30)) for j in range(n + 1)] for i in range(n + 1)]
    ids = [chr(97 + i) for i in range(n)]
    opens = [float(rng.choice([540, 585, 700])) for _ in ids]
    return routing.Zone(ids, [[i] for i in ids], [20.0] * n, opens, [o + 200 for o in opens], [[x * 2 for x in r] for r in km], km, {i: rng.randint(0, 1) for i in ids}, end=900.0, max_stops=stops)


def test_routes_equal_permutations():
    rng = random.Random(1)
    for _ in range(20):
        z = zone(rng, 5, 3)
        z.check()
        best = {}
        for size in range(1, 4):
            for order in itertools.permutations(range(5), size):
                state = (z.start, 0.0, 0.0, (), 0, 0.0)
                for c in order:
                    state = state and routing.visit(z, state, c)
                if state:
                    mask, home = sum(1 << c for c in order), z.minutes[state[4]][0]
                    best[mask] = min(best.get(mask, (1e9,)), (round(state[0] + home - z.start, 3),))
        assert {m: r[:1] for m, r in routing.routes(z).items() if m} == best


def test_exact_plans_are_no_worse_than_greedy_and_days_are_dealt():
    rng = random.Random(2)
    for _ in range(10):
        z = zone(rng, 6, 3)
        plans = routing.fleets(z, 2)
        assert routing.plan_key(z, *plans[-1]) <= routing.plan_key(z, *routing.greedy(z, 2))
        assert sum(routing.covered(z, plans[0][0])) <= sum(routing.covered(z, plans[1][0]))
    options = {"a": [((0, 0), 0.0), ((1, 1), 5.0), ((2, 1), 9.0)], "b": [((0, 0), 0.0), ((0, 3), 4.0)], "c": [((0, 0), 0.0)]}
    assert routing.allocate(options, 3) == {"a": 2, "b": 1, "c": 0} and routing.allocate(options, 2) == {"a": 1, "b": 1, "c": 0}
    with pytest.raises(ValueError):
        routing.allocate(options, 1)
    assert routing.clock("09:30") == 570
    with pytest.raises(ValueError):
        routing.clock("9:30")


@pytest.mark.parametrize("sites", [1, 2, 4, 8])
def test_plans_of_many_zones_equal_fleets(sites):
    rng = random.Random(sites)
    for scale, grid in ((5, 1.0), (60, 0.001), (200, 0.25)):
        ids = np.sort([rng.sample(range(15_000), sites) for _ in range(6)], axis=1)
        x, y = (np.array([[round(rng.random() * scale / grid) * grid for _ in range(sites)] for _ in ids]) for _ in "xy")
        tier = np.array([[rng.randint(0, 1) for _ in range(sites)] for _ in ids])
        got = routing.plane_options(ids, x, y, tier, 4, 40.0, 45.0)
        for k in range(len(ids)):
            z = routing.plane_zone(pd.DataFrame({"id": ids[k], "x": x[k], "y": y[k], "tier": tier[k]}), 4, 40.0, 45.0)
            want = [(*routing.covered(z, mask), float(sum(r[1] for r in plan))) for mask, plan in [(0, ()), *routing.fleets(z, 2)]]
            assert [(a[k], b[k], c[k]) for a, b, c in got] == want
    with pytest.raises(ValueError):
        routing.plane_options(np.array([[1, 1]]), np.zeros((1, 2)), np.zeros((1, 2)), np.zeros((1, 2)), 4, 40.0, 45.0)


def test_days_dealt_by_gain_equal_allocate():
    rng = random.Random(9)
    for _ in range(100):
        options = {}
        for zone in rng.sample(range(50), rng.randint(1, 7)):
            a, b = ((rng.randint(0, 2), rng.randint(0, 2)) for _ in "ab")
            cost = rng.randint(0, 3) / 1000
            options[str(zone)] = [((0, 0), 0.0), (a, cost), (rng.choice([a, b, (2 * a[0], 2 * a[1])]), cost + rng.randint(0, 3) / 1000)]
        for days in (0, 1, 3 * len(options) // 2, 50):
            assert routing.deal(options, days) == routing.allocate(options, days, 0)
    many = {str(i): [((0, 0), 0.0), ((i % 5 + 1, 1), 1.0), ((i % 5 + 2, 1), 2.0)] for i in range(20_000)}
    assert sum(routing.deal(many, 30_000).values()) == 30_000


def test_days_dealt_in_groups_equal_allocate(spark):
    rng, rows, want = random.Random(4), [], []
    for g, zones in enumerate((1, 2, 3, 9, 40)):
        options = {}
        for z in rng.sample(range(95, 95 + 3 * zones), zones):
            p, q, t = rng.randint(0, 3), rng.randint(0, 2), rng.randint(1, 9) / 8
            more = (rng.randint(0, p), rng.randint(0, q)) if p or q else (0, 0)
            first = ((p, q), t if p or q else 0.0)
            options[str(g * 1000 + z)] = [((0, 0), 0.0), first, ((p + more[0], q + more[1]), first[1] + (t + rng.randint(0, 3) / 8 if any(more) else 0.0))]
        rows += [(g, int(z), n, *tiers, cost) for z, by in options.items() for n, (tiers, cost) in enumerate(by)]
        dealt = routing.allocate(options, 3 * zones // 2, 0)
        want += [(g, int(z), n, *options[z][n][0], options[z][n][1]) for z, n in dealt.items()]
    schema = "g long, zone long, days long, p1 long, p2 long, travel double"
    deal = lambda rows: routing.deal_groups(spark.createDataFrame(rows, schema), "g", F.expr("zones * 3 div 2"))
    assert sorted(map(tuple, deal(rows).select("g", "zone", "days", "p1", "p2", "travel").collect())) == sorted(want)
    with pytest.raises(Exception, match="a day gains more than the one before"):
        deal([(0, 1, 0, 0, 0, 0.0), (0, 1, 1, 1, 0, 1.0), (0, 1, 2, 3, 0, 2.0)]).collect()


def test_rounding_of_arrays_equals_python():
    rng = random.Random(10)
    xs = np.array([rng.randint(0, 10**6) / 16 for _ in range(500)] + [rng.randint(0, 10**7) * 0.0015 for _ in range(500)] + [rng.random() * 500 for _ in range(500)])
    assert all(routing.rounded(xs, n).tolist() == [round(x, n) for x in xs.tolist()] for n in (3, 6))


def test_ward_and_silhouette():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (15, 2)) for c in (0, 4, 9)])
    labels = clustering.ward(x, 3)
    assert [len(set(labels[i : i + 15])) for i in (0, 15, 30)] == [1, 1, 1] and len(set(labels)) == 3
    assert clustering.silhouette(x, labels) > 0.8 > clustering.silhouette(x, np.arange(45) % 3)
    assert clustering.choose([{"k": 2, "silhouette": 0.9, "gates": {"a": False}}, {"k": 3, "silhouette": 0.5, "gates": {"a": True}}])["k"] == 3


def test_ward_on_a_line_equals_ward():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 9, 40, 150):
        for x in (rng.normal(0, 3, n), rng.choice(rng.normal(0, 3, max(1, n // 4)), n), np.zeros(n), np.exp(rng.normal(0, 2, n))):
            for k in (1, 2, 3, 7):
                if k <= n:
                    assert clustering.ward_line(x, k).tolist() == clustering.ward(x[:, None], k).tolist()


def test_many_rows_of_one_group_need_no_matrix(spark):
    """30,000 rows, whose matrix of distances would have 7.2 GB."""
    df = spark.range(30_000).select("id", ((F.col("id") * 7919 % 30_011) + (F.col("id") % 3) * 1e6).alias("x"))
    told = clustering.sensitivity(df, "id", ["x"], 3).first()
    assert 0 < told.ari <= 1 and 0 < told.least_jaccard <= 1
    got = clustering.ward_groups(df.select("id", "x", F.lit(0).cast("long").alias("g")), "id", "g", ["x"], 3).collect()
    assert all(r.cluster == r.id % 3 for r in got) and len(got) == 30_000


def test_stability(spark):
    x = np.concatenate([np.random.default_rng(4).normal(c, 0.1, (10, 2)) for c in (0, 5)])
    assert [r.ari for r in clustering.stability(spark, x, 2, rounds=6).collect()] == [1.0] * 6


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert polygons.interior_point([ring]) == (2.0, 2.0, "centroid")
    x, y, how = polygons.interior_point([ring, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]])
    assert how == "scanline" and not (1 < x < 3 and 1 < y < 3)
    assert polygons.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    r = spark.createDataFrame([([ring],)], "p array<array<struct<lon:double,lat:double>>>")
    area, at = r.select(geo.area_km2(r.p), geo.shoelace(r.p[0])).first()
    assert abs(area - 16 * 111.32 * 110.574 * np.cos(np.radians(2))) < 1e-6 and tuple(at) == (16.0, 2.0, 2.0)


@pytest.mark.parametrize("band", [100_000, 300])
def test_every_customer_stands_in_one_zone(spark, monkeypatch, band):
    monkeypatch.setattr(routes, "BAND_SITES", band)
    d = DATA.replace("0.001", "0.01")
    rows = routes._sites(spark, d).collect()
    assert sorted(r.id for r in rows) == sorted(r.c_custkey for r in registry.read(spark, d, "customer").collect())
    sizes = {}
    for r in rows:
        sizes[r.zone] = sizes.get(r.zone, 0) + 1
    assert 2 <= min(sizes.values()) and max(sizes.values()) <= routing.MAX_CANDIDATES


def test_zones_and_route_days_know_no_switch_by_size(spark, monkeypatch):
    """However many customers one task sorts, they stand in the same zones, and each nation's days are dealt among all its zones."""
    d, zones, dealt = DATA.replace("0.001", "0.01"), [], []
    for band in (100_000, 300):
        monkeypatch.setattr(routes, "BAND_SITES", band)
        zones.append(sorted((r.zone, r.id) for r in routes._sites(spark, d).collect()))
        dealt.append(sorted(map(tuple, registry.QUERIES["zone_knapsack"](spark, d).collect())))
    assert zones[0] == zones[1] and dealt[0] == dealt[1]
    nation_of = {r.c_custkey: r.c_nationkey for r in registry.read(spark, d, "customer").collect()}
    assert {(z >> 44, z) for z, _ in zones[0]} == {(nation_of[i], z) for z, i in zones[0]} == {r[:2] for r in dealt[0]}


def test_customers_without_a_nation_stand_in_zones(spark, tmp_path):
    c = registry.read(spark, DATA, "customer").withColumn("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")))
    c.write.parquet(str(tmp_path / "customer.parquet"))
    rows = routes._sites(spark, str(tmp_path)).collect()
    sizes = {z: sum(r.zone == z for r in rows) for z in {r.zone for r in rows}}
    assert len(rows) == c.count() and None not in sizes and max(sizes.values()) <= 8
    assert {r.zone for r in registry.QUERIES["zone_knapsack"](spark, str(tmp_path)).collect()} == set(sizes)


def test_route_plans_know_only_their_zones_sites(spark):
    zone_of = {str(r.id): r.zone for r in routes._sites(spark, DATA).collect()}
    seen = [(r.method, s, r.zone) for r in registry.QUERIES["route_plans"](spark, DATA).collect() for s in r.stops.split(">")]
    assert len(seen) == len({s[:2] for s in seen}) and all(zone_of[s] == z for _, s, z in seen)


def test_supplier_shortest_equals_dijkstra(spark):
    edges, n = {}, registry.read(spark, DATA, "customer").count()
    for r in graphs._edges(spark, DATA).collect():
        edges.setdefault(r.src, []).append((r.dst, float(r.weight)))
    seeds = {r.s_suppkey * 7 % n for r in registry.read(spark, DATA, "supplier").collect()}
    best, heap = {}, [(0.0, s, s) for s in seeds]
    heapq.heapify(heap)
    while heap:
        dist, origin, node = heapq.heappop(heap)
        if node not in best:
            best[node] = (dist, origin)
            for dst, w in edges.get(node, []):
                heapq.heappush(heap, (dist + w, origin, dst))
    got = {r.node: (r.dist, r.origin) for r in registry.QUERIES["supplier_shortest"](spark, DATA).collect()}
    assert got == best and len(seeds) < len(best)


def test_normalized_text_is_whole(spark, oracle):
    want = dict(oracle.sql(registry.ORACLE_SQL["normalized_text"]).fetchall())
    got = {r.doc_id: r.norm for r in registry.QUERIES["normalized_text"](spark, DATA).collect()}
    assert got == want and max(map(len, got.values())) > 200


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    xs = [2.675, 0.125, 0.375, 1.005, -2.5, 5.12345, 0.0] + [rng.uniform(-1e6, 1e6) for _ in range(400)] + [rng.randint(-10**6, 10**6) / 8 for _ in range(200)] + [rng.randint(0, 10**7) / 1e5 for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in (0, 1, 2, 4):
        assert [r[0] for r in df.select(numbers.round_half_even(F.col("x"), n)).collect()] == [round(x, n) + 0.0 for x in xs]


def brute_fleets(z, vehicles):
    """Every choice of disjoint sets, by vehicle."""
    single = routing.routes(z)

    def grow(mask, plan):
        yield mask, plan
        if len(plan) < vehicles:
            for more, route in single.items():
                if more and not mask & more:
                    yield from grow(mask | more, (*plan, route))

    return min(grow(0, ()), key=lambda p: routing.plan_key(z, *p))


def test_fleets_equal_exhaustive_search():
    rng = random.Random(6)
    for _ in range(12):
        z = zone(rng, 5, 3)
        best, want = routing.fleets(z, 2)[-1], brute_fleets(z, 2)
        assert routing.plan_key(z, *best) == routing.plan_key(z, *want)


def test_nearest_and_radius_anywhere_on_the_sphere(spark):
    rng = random.Random(7)
    place = lambda i: (i, rng.choice([70.0, -89.9, 89.0, 0.0, 35.0]) + rng.random() / 10, (rng.choice([179.95, -180.0, 0.0, 127.0]) + rng.random() / 20 + 180) % 360 - 180)
    left, right = [place(i) for i in range(120)], [place(1000 + i) for i in range(120)] + [(5000, -33.0, 18.0)]

    def km(a, b):
        p, q, dl = np.radians(a[1]), np.radians(b[1]), np.radians(b[2] - a[2])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(dl / 2) ** 2
        return float(2 * 6371.0088 * np.arcsin(np.sqrt(min(1.0, h))))

    a, b = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "pid long, plat double, plon double")
    got = {(r.id, r.pid) for r in spatial.radius_join(a, b, 5.0).collect()}
    assert got == {(x[0], y[0]) for x in left for y in right if km(x, y) <= 5.0} and len(got) > 50
    near = {r.id: r.dist for r in spatial.nearest(a, b.where("pid = 5000")).collect()}
    assert near.keys() == {x[0] for x in left} and all(abs(near[x[0]] - km(x, right[-1])) < 1e-5 for x in left)


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.root for r in graph.components(edges).collect()} == want
    assert graph.components(edges.where("false")).count() == 0


def test_numbers_and_quantiles_over_ranges(spark):
    rows = [(i * 7919 % 1000 / 3, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, id long")
    got = [r.id for r in ranking.numbered(df, F.col("x"), F.col("id")).orderBy("nth").collect()]
    assert got == [i for _, i in sorted(rows)]
    assert spark.range(1).select(ranking.exact_quantile(df, "x", 0.37)).first()[0] == pytest.approx(np.quantile([x for x, _ in rows], 0.37))


def test_readers_and_writers(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_bytes(data)
    write("a.csv", "\ufeffk,65세,66세,n\nx,\"1,200\",,é\ny,3,4,\n".encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("x", "1,200", None, "é"), ("y", "3", "4", None)]
    assert {r.k: r.total for r in tables.read_wide_csv(spark, str(tmp_path / "a.csv"), "k", "total", ("65세", "66세")).collect()} == {"x": 1200.0, "y": 7.0}
    write("b.csv", b"k,65\nx,1\nx,2\n")
    with pytest.raises(Exception, match="repeated key x"):
        tables.read_wide_csv(spark, str(tmp_path / "b.csv"), "k", "total", ("65",)).collect()
    write("c.txt", "전주".encode("cp949"))
    assert tables.read_text(spark, str(tmp_path / "c.txt")).first().text == "전주"
    write("g.json", b'{"features": [{"properties": {"sido": "52"}, "geometry": {"type": "Point"}}]}')
    assert tables.read_features(spark, str(tmp_path / "g.json")).first().properties.sido == "52"
    (tmp_path / "pages").mkdir()
    write("pages/1.json", b'{"body": {"totalCount": 3, "items": [{"a": 1}, {"a": 2}]}}')
    write("pages/2.json", b'{"response": {"body": {"totalCount": 3, "items": {"item": {"a": 3}}}}}')
    assert sorted(r.row["a"] for r in tables.read_pages(spark, str(tmp_path / "pages")).collect()) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        tables.read_pages(spark, str(tmp_path / "pages"), max_pages=1)
    write("pages/2.json", b'{"body": {"totalCount": 3, "items": []}}')
    with pytest.raises(ValueError):
        tables.read_pages(spark, str(tmp_path / "pages"))
    found = tables.hashes(spark, str(tmp_path / "b.csv")).withColumn("name", F.lit("b"))
    listed = found.select("name", "bytes", "sha256").unionByName(spark.createDataFrame([("z", 1, "h")], "name string, bytes long, sha256 string"))
    assert {r.name: r.status for r in tables.lineage(found, listed).collect()} == {"b": "ok", "z": "missing"}
    df = spark.createDataFrame([(1, "x"), (2, None)], "n long, t string")
    tables.write_csv(df, str(tmp_path / "out"), ["t", "n"])
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "out")).collect()} == {("x", "1"), (None, "2")}
    tables.write_json(df, str(tmp_path / "json"))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "json")).select("n", "t").collect()} == {(1, "x"), (2, None)}
    assert tables.markdown(df) == "| n | t |\n| --- | --- |\n| 1 | x |\n| 2 |  |"
    report = "# T\n\n## 5\nold\n## 6\nsix\n## 7\nend\n"
    once = tables.spliced(report, "## 6", "new")
    assert once == tables.spliced(once, "## 6", "new") and "six" not in once and once.index("new") < once.index("## 7") and "old" in once


def test_rings_stay_rings():
    ring = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert polygons.simplify_ring(ring, 0.1) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)] or len(polygons.simplify_ring(ring, 0.1)) >= 4
    assert polygons.simplify_ring(ring[:3], 5.0) == ring[:3]


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A folder of many customers and suppliers at few places, some of these near each other, and DuckDB over it."""
    d, con = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    con.execute(f"create view c as select * from '{DATA}/customer.parquet' limit 150")
    con.execute(f"create view s as select * from '{DATA}/supplier.parquet' limit 10")
    at = "SELECT k FROM range(10000) t(k) WHERE (k*7919) % 10000 < 700 AND (k*104729) % 10000 < 700"  # 8 km by 10 km
    con.execute(f"copy (SELECT c.* REPLACE (p.k + 10000 * (row_number() OVER (PARTITION BY p.k ORDER BY c_custkey)) AS c_custkey) FROM ({at}) p JOIN c ON (c_custkey + p.k) % 21 = 0) to '{d}/customer.parquet' (format parquet)")
    con.execute(f"copy (SELECT s.* REPLACE (p.k + 10000 * s_suppkey AS s_suppkey, (p.k % 3)::INT AS s_nationkey) FROM ({at}) p, s) to '{d}/supplier.parquet' (format parquet)")
    for t in ("customer", "supplier"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return str(d), con


CROWDED = ["proximity_components", "component_summary", "grid_neighbor_pairs", "knn_in_key", "radius_counts"]


@pytest.mark.parametrize("name", CROWDED)
def test_crowded_places_equal_sql_and_meet_once(spark, crowded, monkeypatch, name):
    d, con = crowded
    met = []

    def once(left, right, km, on=()):
        met.append(max(side.count() for side in (left, right)))
        return join(left, right, km, on)

    join = spatial.radius_join
    for module in (spatial, access):
        monkeypatch.setattr(module, "radius_join", once)
    df, want = registry.QUERIES[name](spark, d), con.sql(registry.ORACLE_SQL[name])
    of = lambda rows, names: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in rows)
    got = of(df.collect(), df.columns)
    assert got == of(want.fetchall(), want.columns) and got
    keys = {"knn_in_key": "c_nationkey, c_custkey % 10000"}.get(name, "c_custkey % 10000")
    places = con.sql(f"SELECT count(*) FROM (SELECT DISTINCT {keys} FROM customer)").fetchall()[0][0]
    areas = con.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    stands = con.sql("SELECT count(*) FROM (SELECT DISTINCT s_nationkey, s_suppkey % 10000 FROM supplier)").fetchall()[0][0] * (3 if name == "knn_in_key" else 1)
    assert met and max(met) <= max(places, stands) and (name == "knn_in_key" or 2 * max(met) < areas)


def test_components_of_few_edges_take_no_rounds(spark, crowded, monkeypatch):
    rng = random.Random(8)
    pairs = [(i + 1, i) for i in range(400)] + [(1000 + 2 * i, 1000) for i in range(300)] + [(rng.randrange(2000, 4000), rng.randrange(2000, 4000)) for _ in range(900)] + [(-7, 5000), (9, 9)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    rounds = {r.node: r.root for r in graph.components(edges, alone=0).collect()}
    assert {r.node: r.root for r in graph.components(edges).collect()} == rounds
    assert graph.components(edges.where("a = b")).count() == 0

    written = []
    monkeypatch.setattr(graph, "staged", lambda df, label: written.append(label) or tables.staged(df, label))
    d, _ = crowded
    assert registry.QUERIES["component_summary"](spark, d).count()
    assert len(written) == 2
