"""Rules and readings of single tags against hand-made cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo, parse
from pathloom.functions.rules import Rules
from pathloom.operators import choose, network, spatial

NUMBERS = [("1.5", 1.5), ("1,5 m", 1.5), ("2", 2.0), ("1.5m", None), ("1e3", 1000.0), ("", None), ("nan", None), ("1_0", None), (None, None), ("  7 x", 7.0), ("-3", -3.0), (".5", 0.5)]
SPEEDS = [("80", 80.0), ("50 mph", 50 * 1.609), ("FR:rural", 80.0), ("FR:urban", 50.0), ("FR:zone30", 30.0), ("signals", None), (None, None)]


def test_numbers(spark):
    rows = spark.createDataFrame(NUMBERS, "v string, want double").select("want", parse.lenient_number(F.col("v")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_speeds_fall_through_to_the_next_tag(spark):
    df = spark.createDataFrame([({"maxspeed": v} if v else {}, w) for v, w in SPEEDS] + [({"maxspeed": "signals", "maxspeed:type": "FR:rural"}, 80.0)], "tags map<string,string>, want double")
    for r in df.select("want", parse.allowed_speed(F.col("tags")).alias("got")).collect():
        assert r.got == pytest.approx(r.want) if r.want is not None else r.got is None


CASES = [
    ({"highway": "motorway"}, "normal", False, "highway"), ({}, "normal", False, "highway"), ({"highway": "footway"}, "normal", False, None),
    ({"highway": "path"}, "normal", False, "unproven_path"), ({"highway": "path"}, "normal", True, None), ({"highway": "path"}, "strict", True, "soft_path"),
    ({"highway": "path"}, "tolerant", False, None), ({"highway": "path", "surface": "sand"}, "tolerant", True, "surface"), ({"highway": "track", "surface": "grass"}, "normal", True, "risky_surface"),
    ({"highway": "footway", "access": "private"}, "normal", False, "access"), ({"highway": "footway", "access": "private", "foot": "yes"}, "normal", False, None),
    ({"highway": "footway", "foot": "destination"}, "tolerant", False, "foot"), ({"highway": "tertiary", "maxspeed": "80"}, "normal", False, "danger"),
    ({"highway": "tertiary", "maxspeed": "80"}, "tolerant", False, None), ({"highway": "tertiary", "maxspeed": "80", "sidewalk": "left"}, "normal", False, None),
    ({"highway": "footway", "width": "0,5 m"}, "normal", False, "width"), ({"highway": "footway", "ford": "yes"}, "normal", False, "ford"), ({"highway": "footway", "sac_scale": "hiking"}, "normal", False, None),
    ({"highway": "footway", "sac_scale": "mountain_hiking"}, "normal", False, "sac_scale"), ({"highway": "service", "service": "driveway"}, "normal", False, "service"),
]


def test_refusals(spark):
    ways = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "way_id long, tags map<string,string>")
    marked = spark.createDataFrame([(i,) for i, c in enumerate(CASES) if c[2]], "way_id long")
    got = {(r.way_id, r.level): r for r in network.judged(ways, marked).collect()}
    for i, (tags, level, _, want) in enumerate(CASES):
        assert got[i, level].reason == want, (tags, level)
        assert (got[i, level].verdict is None) == (want is not None)


def test_costs(spark):
    ways = spark.createDataFrame([(1, {"highway": "path", "name": "x", "trail_visibility": "good"}), (2, {"highway": "tertiary", "maxspeed": "90"})], "way_id long, tags map<string,string>")
    got = {(r.way_id, r.level): r.verdict for r in network.judged(ways, spark.createDataFrame([(1,)], "way_id long")).collect()}
    assert got[1, "normal"].cost == pytest.approx(1.10 * 1.45 * 0.90 * 0.95 * 0.85) and got[1, "normal"].quality == "marked"
    assert got[2, "tolerant"].cost == pytest.approx(1.90 * 1.6 * 3.0) and got[2, "tolerant"].quality == "street"


def test_no_routes_and_no_barriers_are_allowed(spark):
    ways = spark.createDataFrame([(1, {"highway": "footway"}, [1, 2, 2], [(47.0, 5.0), (47.001, 5.0), (47.001, 5.0)]), (2, {"highway": "footway"}, [1], [(47.0, 5.0)])], "way_id long, tags map<string,string>, nodes array<long>, geometry array<struct<lat:double,lon:double>>")
    rows = network.passable(ways).filter("level = 'normal'").collect()
    assert [(r.src, r.dst) for r in rows] == [(1, 2)] and rows[0].length_m == pytest.approx(111.195, abs=0.01)
    blocked = spark.createDataFrame([(2, {"barrier": "wall"})], "node_id long, tags map<string,string>")
    assert network.passable(ways, barriers=blocked).count() == 0


def test_geometry(spark):
    row = spark.range(1).select(
        geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("east"), geo.destination(F.lit(0.0), F.lit(179.999), F.lit(90.0), F.lit(1000.0)).alias("over"),
        geo.point_to_segment(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0), F.lit(0.001), F.lit(0.0)).alias("flat"), geo.slope_class(F.lit(-3.0)).alias("down"), geo.slope_class(F.lit(3.0)).alias("level"),
        geo.terrain_metres(F.lit(128), F.lit(42), F.lit(128)).alias("height"),
    ).first()
    assert row.east == pytest.approx(90) and -180 <= row.over.lon < -179.9 and row.flat == pytest.approx(111.32) and (row.down, row.level) == ("down", "flat") and row.height == pytest.approx(42.5)


def test_score_orders_inside_the_tolerance_first(spark):
    rows = [(1, 1, 5000.0, 0.0, 0.0, 5000.0), (1, 2, 4900.0, 0.0, 0.0, 5000.0), (1, 3, 5200.0, 100.0, 0.0, 5000.0), (1, 4, 6000.0, 0.0, 0.0, 5000.0)]
    df = spark.createDataFrame(rows, "request_id long, candidate_id long, length_m double, repeated_m double, turns double, target_m double")
    assert [r.candidate_id for r in choose.best(df, n=4).orderBy("rank").collect()] == [1, 3, 2, 4]


def test_sets_of_the_rules_are_parameters(spark):
    tags = [{"highway": "footway", "surface": "gravel"}, {"highway": "path", "surface": "clay"}, {"highway": "footway", "obstacle": "log"}, {"highway": "footway", "obstacle": "sofa"}, {"highway": "steps"}, {"highway": "footway", "access": "members"}]
    ways = spark.createDataFrame(list(enumerate(tags)), "way_id long, tags map<string,string>")
    own = Rules(base_cost={"footway": 1.0, "path": 1.5}, hard={"clay"}, soft=(), risky=[], forbidden_surface={"gravel"}, blocking={"sofa"}, closed={"members"}, barriers=(), foot_allowed={"yes"})
    reasons = lambda rules: [r.reason for r in network.judged(ways, levels=("strict",), rules=rules).orderBy("way_id").collect()]
    assert reasons(Rules()) == [None, "risky_surface", "obstacle", None, None, None]
    assert reasons(own) == ["surface", None, None, "obstacle", "highway", "access"]
    gates = spark.createDataFrame([(1, {"barrier": "wall"}), (2, {"barrier": "gate", "access": "members"}), (3, {"barrier": "gate", "locked": "yes", "foot": "designated"})], "node_id long, tags map<string,string>")
    blocked = lambda rules: sorted(r.node_id for r in network.blocked_nodes(gates, rules).collect())
    assert blocked(Rules()) == [1] and blocked(own) == [2, 3]
    with pytest.raises(TypeError):
        Rules(hard="asphalt")


def test_counts_in_areas_are_those_of_all_points(spark):
    pick = random.Random(4)
    points = [(k, 47 + pick.random() * 0.6, 5 + pick.random() * 0.9) for k in range(3000)] + [(5000 + k, 47.2, 5.3) for k in range(50)]
    areas = [(k, 47 + pick.random() * 0.6, 5 + pick.random() * 0.9, 10.0 ** (2 + 2.4 * pick.random())) for k in range(40)] + [(100, 47.2, 5.3, 0.0), (101, -60.0, 5.0, 3000.0), (102, 47.2, 5.3, 25000.0)]
    nodes = spark.createDataFrame(points, "node_id long, lat double, lon double")
    asked = spark.createDataFrame(areas, "request_id long, lat double, lon double, radius_m double")
    got = {r.request_id: r.n for r in spatial.count_in_areas(asked, nodes).collect()}
    want = Counter(r.request_id for r in spatial.in_areas(asked, nodes).collect())
    box = {a[0]: (a[3] / geo.METRES_PER_DEGREE, a[3] / (geo.METRES_PER_DEGREE * max(math.cos(math.radians(a[1])), 0.01)), a[1], a[2]) for a in areas}
    brute = {k: n for k, (h, w, lat, lon) in box.items() if (n := sum(lat - h <= p[1] <= lat + h and lon - w <= p[2] <= lon + w for p in points))}
    assert {k: n for k, n in got.items() if n} == want == brute and got[100] == 50 and max(got.values()) > 500


def test_nearest_among_dense_nodes_is_the_nearest_of_all(spark):
    pick = random.Random(6)
    city = [(k, 47.2 + pick.gauss(0, 0.001), 5.3 + pick.gauss(0, 0.001)) for k in range(1500)] + [(k, 47.2, 5.3) for k in range(9000, 9300)]
    land = [(2000 + k, 47 + pick.random() * 0.4, 5 + pick.random() * 0.6) for k in range(600)]
    far = [(4000 + k, lat + pick.gauss(0, 0.003), ((lon + pick.gauss(0, 0.01) + 180) % 360) - 180) for k, (lat, lon) in enumerate([(-20.0, 180.0), (89.98, 10.0), (70.0, -179.999)] * 60)]
    far = [(k, min(lat, 89.9999), lon) for k, lat, lon in far]
    nodes = [*city, *land, *far, (7000, None, 5.0), (7001, 47.2, None)]
    spots = [(47.2 + pick.gauss(0, 0.004), 5.3 + pick.gauss(0, 0.004)) for _ in range(150)] + [(47 + pick.random() * 0.4, 5 + pick.random() * 0.6) for _ in range(150)] + [n[1:] for n in far[::4]]
    spots += [(-20.0, -179.999), (89.9999, -170.0), (89.999, 100.0), (47.2, 5.3), (10.0, 10.0), (None, 5.0)]
    points = spark.createDataFrame([(k, *spot) for k, spot in enumerate(spots)], "point_id long, lat double, lon double")
    held = spark.createDataFrame(nodes, "node_id long, lat double, lon double")
    shown = lambda df: {r.point_id: (r.node_id, r.distance_m and round(r.distance_m, 6)) for r in df.collect()}
    every = points.crossJoin(held.select("node_id", F.col("lat").alias("y"), F.col("lon").alias("x"))).withColumn("d", geo.great_circle(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")))
    for radius in (1500.0, 60.0):
        best = every.filter(F.col("d") < radius).groupBy("point_id").agg(F.min(F.struct("d", "node_id")).alias("b"))
        want = shown(points.join(best, "point_id", "left").select("point_id", "b.node_id", F.col("b.d").alias("distance_m")))
        assert shown(spatial.nearest_dense(points, held, radius)) == want
        assert sum(v[0] is None for v in want.values()) > 1 and len(want) == len(spots)
