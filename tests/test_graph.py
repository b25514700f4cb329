"""Graph jobs on small hand-made graphs."""

from pyspark.sql import functions as F

from pathloom.operators import graph, network, spatial


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
    got = {r.node: r.component for r in graph.components(_edges(spark, pairs).toDF("a", "b")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[k] == 100 for k in range(101, 130))


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_core_keeps_the_square_and_parallel_edges(spark):
    edges = _edges(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (7, 8), (7, 8), (8, 9)])
    assert sorted((r.src, r.dst) for r in graph.two_core(edges).collect()) == [(1, 2), (2, 3), (3, 4), (4, 1), (7, 8), (7, 8)]


def test_cheapest_takes_the_detour(spark):
    edges = _edges(spark, [(1, 2), (2, 3), (1, 3), (8, 9)]).withColumn("weight", F.when((F.col("src") == 1) & (F.col("dst") == 3), 5.0).otherwise(1.0))
    got = {r.node: (r.cost, r.parent) for r in graph.cheapest(edges, spark.createDataFrame([(0, 1)], "query long, node long")).collect()}
    assert got == {1: (0.0, None), 2: (1.0, 1), 3: (2.0, 2)}


def test_reachable(spark):
    found = graph.reachable(_edges(spark, [(1, 2), (2, 3), (8, 9)]).toDF("a", "b"), spark.createDataFrame([(3,)], "node long"))
    assert sorted(r.node for r in found.collect()) == [1, 2, 3]


def test_nearest_is_exact_and_ties_go_to_the_smaller(spark):
    nodes = spark.createDataFrame([(1, 47.0, 5.0), (2, 47.0, 5.002), (3, 48.0, 5.0)], "node_id long, lat double, lon double")
    points = spark.createDataFrame([(1, 47.0, 5.001), (2, 47.5, 5.0)], "point_id long, lat double, lon double")
    got = {r.point_id: r.node_id for r in spatial.nearest(points, nodes, 400.0).collect()}
    assert got[2] is None and got[1] in (1, 2)


def test_degrees_count_parallel_edges_and_loops(spark):
    got = {r.node: r.degree for r in network.degrees(_edges(spark, [(1, 2), (1, 2), (3, 3)])).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def test_half_edges_go_both_ways(spark):
    assert sorted((r.src, r.dst) for r in network.half_edges(_edges(spark, [(1, 2), (2, 3)])).collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_contraction_joins_chains_keeps_parallels_and_drops_rings(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (10, 11), (11, 12), (12, 10), (20, 21), (20, 21), (20, 22)]
    rows = [(w, 0, a, b, 10.0 + w, 2.0, "path", "hard") for w, (a, b) in enumerate(pairs)]
    steps = spark.createDataFrame(rows, "way_id long, pos long, src long, dst long, length_m double, cost double, highway string, quality string")
    got = sorted((r.u, r.v, r.length_m, r.weight, r.polyline) for r in graph.contract(steps).collect())
    assert got[0] == (1, 4, 33.0, 66.0, [1, 2, 3, 4]) and [g[:2] for g in got[1:3]] == [(4, 5), (4, 6)]
    assert not any(10 in g[4] for g in got) and sum(g[2] for g in got) == sum(r[4] for w, r in enumerate(rows) if w not in (5, 6, 7))
    ring = [r for r in graph.contract(steps, spark.createDataFrame([(10,)], "node long")).collect() if 10 in r.polyline]
    assert len(ring) == 1 and (ring[0].u, ring[0].v, ring[0].length_m) == (10, 10, 15.0 + 16 + 17)


def test_a_street_and_its_sidewalks_are_one_corridor(spark):
    from pathloom.operators import corridors

    step = 8 / 111320
    line = lambda k, turned=False: [(47.0 + k * step, 5.0 + 0.0005 * i) for i in (range(16, -1, -1) if turned else range(17))]
    cross = [(47.0 - 0.002 + 0.0005 * i, 5.004) for i in range(9)]
    rows = [(1, 600.0, line(0)), (2, 600.0, line(1)), (3, 600.0, line(-1, True)), (4, 440.0, cross)]
    edges = spark.createDataFrame(rows, "edge_id long, length_m double, line array<struct<lat:double,lon:double>>")
    assert sorted((r.a, r.b) for r in corridors.twins(edges).collect()) == [(1, 2), (1, 3)]
    got = {r.edge_id: (r.corridor_id, round(r.offset_m), r.alignment) for r in corridors.corridors(edges).collect()}
    assert got == {1: (1, 0, 1), 2: (1, 8, 1), 3: (1, -8, -1), 4: (4, 0, 1)}
