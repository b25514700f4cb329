"""Traces with known defects, and the registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from pathloom.jobs import registry
from pathloom.operators import relief, traces

SMALL = "/root/testdata/sf0.001"


def _trace(spark, points, name=1):
    return spark.createDataFrame([(name, i, lat, lon) for i, (lat, lon) in enumerate(points)], "trace_id long, seq long, lat double, lon double")


def test_there_and_back_is_doubled(spark):
    out = [(47.0, 5.0 + 0.0003 * i) for i in range(20)]
    r = traces.overlap(_trace(spark, out + out[::-1])).first()
    assert r.n_portions >= 1 and r.overlap_m > 700


def test_a_square_has_no_defect(spark):
    side = 40
    square = [(47.0, 5.0 + 0.0002 * i) for i in range(side)] + [(47.0 + 0.0002 * i, 5.0 + 0.0002 * side) for i in range(side)]
    square += [(47.0 + 0.0002 * side, 5.0 + 0.0002 * (side - i)) for i in range(side)] + [(47.0 + 0.0002 * (side - i), 5.0) for i in range(side + 1)]
    df = _trace(spark, square)
    assert traces.overlap(df).first().overlap_m == 0 and traces.small_loops(df).first().n_small_loops == 0 and traces.summary(df).first().closed


def test_short_and_empty_traces(spark):
    df = _trace(spark, [(47.0, 5.0), (47.001, 5.0)])
    assert traces.overlap(df).first().n_portions == 0 and traces.sharp_turns(df).first().n_turns == 0
    assert traces.overlap(df.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "most", "left"), [(10, 100, 10), (100, 10, 11), (7, 3, 3), (9, 4, 4), (1, 1, 1)])
def test_thinning_keeps_the_last_point(spark, size, most, left):
    rows = traces.thinned(_trace(spark, [(47.0 + i / 1000, 5.0) for i in range(size)]), most).orderBy("seq").collect()
    assert rows[-1].seq == size - 1 and len(rows) == left


def test_climb_has_hysteresis_and_a_gap_drops_the_trace(spark):
    values = [100.0, 102.0, 104.0, 101.5, 99.0, 99.5, 110.0]
    rows = [(1, i, v) for i, v in enumerate(values)] + [(2, 0, 1.0), (2, 1, None)]
    got = relief.climbs(spark.createDataFrame(rows, "trace_id long, seq long, altitude double")).collect()
    assert [(r.trace_id, r.gain_m, r.loss_m) for r in got] == [(1, 15.0, 5.0)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    shown = lambda rows: sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(tuple(r) for r in df.select(*columns).collect()) == shown(con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_pieces_of_a_long_trace_stay_apart_from_the_next_trace(spark):
    from pathloom.jobs import trace_queries

    # trace 1 goes on beyond 100,000 pieces, trace 2 begins elsewhere; trace 1001 runs beside the far piece of trace 1
    line = lambda t, first, lat: [(t, first + k, lat, 5.0 + k * 0.0003, 0.0) for k in range(8)]
    rows = line(1, 800_000, 47.0) + line(2, 0, 47.5) + line(1001, 0, 47.00005) + line(1002, 0, 47.50005)
    points = spark.createDataFrame(rows, "trace_id long, seq long, lat double, lon double, altitude double")
    lines = trace_queries._lines(points)
    assert sorted((r.edge_id.trace_id, r.edge_id.piece, len(r.line)) for r in lines.collect()) == [(1, 100_000, 8), (2, 0, 8), (1001, 0, 8), (1002, 0, 8)]
    far = -(1 << 63) + (1 << 32) + 100_000
    assert sorted((r.a, r.b) for r in trace_queries.corridors.twins(trace_queries._numbered(lines)).collect()) == [(far, 100_100_000), (200_000, 100_200_000)]


def plain_defects(points):
    """Doubled steps and spans of small loops of one trace by pairs of all points."""
    from math import asin, atan2, cos, hypot, radians, sin, sqrt  # noqa: F401

    far = lambda p, q: 2 * 6371008.8 * asin(sqrt(sin(radians(q[0] - p[0]) / 2) ** 2 + cos(radians(p[0])) * cos(radians(q[0])) * sin(radians(q[1] - p[1]) / 2) ** 2))
    cum = [0.0]
    for p, q in zip(points, points[1:], strict=False):
        cum.append(cum[-1] + far(p, q))
    total, closed = cum[-1], far(points[0], points[-1]) < 25
    cell = lambda p, m: (p[0] * 111320 // m, p[1] * 111320 * cos(radians(p[0])) // m)
    close = lambda a, b: abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1
    mids = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in zip(points, points[1:], strict=False)]
    doubled = set()
    for s, m in enumerate(mids):
        for t in range(len(mids)):
            gap = abs(cum[s] - cum[t])
            if t == s or (min(gap, total - gap) if closed else gap) < 80 or not close(cell(m, 40), cell(mids[t], 40)):
                continue
            w = 111320 * cos(radians(m[0]))
            ax, ay = (points[t][1] - m[1]) * w, (points[t][0] - m[0]) * 111320
            dx, dy = (points[t + 1][1] - points[t][1]) * w, (points[t + 1][0] - points[t][0]) * 111320
            k = 0 if dx == dy == 0 else max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            if hypot(ax + k * dx, ay + k * dy) < 15:
                doubled.add(s)
                break
    spans = {}
    for i, p in enumerate(points):
        fit = [j for j in range(i + 1, len(points)) if 80 <= cum[j] - cum[i] <= total * 0.25 and close(cell(p, 80), cell(points[j], 80)) and far(p, points[j]) < 80 and cum[j] - cum[i] >= 4 * far(p, points[j])]
        if fit:
            spans[i] = max(fit)
    loops, end = [], -1
    for i in sorted(spans):
        if i > end:
            loops.append([cum[i], cum[spans[i]]])
        loops[-1][1] = max(loops[-1][1], cum[spans[i]])
        end = max(end, spans[i])
    return doubled, len(loops), sum(b - a for a, b in loops)


@pytest.mark.parametrize("lon", [5.0, 178.0])
def test_defects_equal_all_pairs(spark, lon):
    """Walks that cross themselves, stay where they are, shake, and come back; also far from the meridian of 0."""
    import random

    from pathloom.operators import traces

    rng, walks = random.Random(6), {}
    for k, (n, step, stay) in enumerate([(250, 30, 0.0), (250, 12, 0.3), (300, 2, 0.1), (200, 60, 0.0), (150, 0.3, 0.5), (3, 50, 0.0)]):
        y, x, points = 0.0, 0.0, []
        for _ in range(n):
            if rng.random() >= stay:
                y, x = y + rng.choice([-1, 0, 1]) * step, x + rng.choice([-1, 0, 1]) * step
            points.append((47 + y / 111320, lon + x / 76000))
        walks[k] = points + ([points[0]] if k == 3 else [])
    rows = [(k, s, *p) for k, points in walks.items() for s, p in enumerate(points)]
    table = spark.createDataFrame(rows, "trace_id long, seq long, lat double, lon double")
    flags = traces.overlap_flags(table).filter("doubled").collect()
    loops = {r.trace_id: r for r in traces.small_loops(table).collect()}
    for k, points in walks.items():
        if len(points) >= 4:
            doubled, n, metres = plain_defects(points)
            assert {r.s for r in flags if r.trace_id == k} == doubled
            assert loops[k].n_small_loops == n and loops[k].small_loop_m == pytest.approx(metres)


def test_a_device_that_stays_is_linear(spark):
    """60,000 points in one cell, shaking by a metre or standing, end as fast as other points."""
    import time

    from pathloom.operators import traces

    place = lambda k: F.col("id") % k * 1e-6
    shaking = spark.range(60_000).select(F.lit(1).alias("trace_id"), F.col("id").alias("seq"), (47 + place(7)).alias("lat"), (5 + place(11)).alias("lon"))
    standing = spark.range(60_000).select(F.lit(2).alias("trace_id"), F.col("id").alias("seq"), F.lit(47.0).alias("lat"), F.lit(5.0).alias("lon"))
    began = time.time()
    both = shaking.unionByName(standing)
    got = {r.trace_id: r for r in traces.overlap(both).join(traces.small_loops(both), "trace_id").collect()}
    assert got[2].overlap_m == 0 and got[1].overlap_m > 15_000 and got[1].n_small_loops == 1 and time.time() - began < 120
