"""What queries shuffle, keep on disk or pair as their tables grow."""

from pathloom.jobs import registry

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corners_of_loops_are_not_shuffled(spark):
    out = plan(registry.queries()["loop_anchors"](spark, SMALL))
    assert "hashpartitioning" not in out and "SortMergeJoin" not in out


def test_steps_between_junctions_take_no_part_in_the_rounds(spark, monkeypatch):
    """Where all nodes are beside each other and two also by a chain, only the chain's steps are written for the rounds, and earlier pointers are dropped."""
    from pathloom.operators import graph
    from pathloom.sources import places

    sizes, written = {}, places._written

    def counted(df, path):
        out = written(df, path)
        sizes.setdefault(path.rsplit("/", 1)[-1].rsplit("-", 1)[0], []).append(out.count())
        return out

    monkeypatch.setattr(places, "_written", counted)
    pairs = [(a, b) for a in range(8) for b in range(a + 1, 8)] + [(0, 20), (20, 21), (21, 22), (22, 7)]
    rows = [(w, 0, a, b, 10.0, 1.0, "path", "hard") for w, (a, b) in enumerate(pairs)]
    steps = spark.createDataFrame(rows, "way_id long, pos long, src long, dst long, length_m double, cost double, highway string, quality string")
    got = {(r.u, r.v, r.length_m) for r in graph.contract(steps).collect()}
    assert got == {(*p, 10.0) for p in pairs if max(p) < 8} | {(0, 7, 40.0)} and len(got) == len(pairs) - 3
    assert max(sizes["halves"]) == 8 and max(sizes["pointers"]) == 8


def test_points_between_the_same_pixels_ask_for_them_once(spark, monkeypatch):
    from pathloom.operators import relief
    from pathloom.sources import places

    sizes, written = {}, places._written

    def counted(df, path):
        out = written(df, path)
        sizes[path.rsplit("/", 1)[-1].rsplit("-", 1)[0]] = out.count()
        return out

    monkeypatch.setattr(places, "_written", counted)
    x0, y0, side = 2155406, 1475247, 360 / (256 << 14)
    points = spark.range(500).selectExpr("id AS point_id", "47.0D AS lat", f"{(x0 + 0.6) * side - 180}D + id % 50 * {side / 100}D AS lon")
    pixels = spark.range(9).selectExpr(f"{x0 - 1} + id % 3 AS x", "id div 3 AS j").selectExpr("x", f"{y0 - 1} + j AS y", f"100D + (x - {x0}) AS altitude")
    got = relief.interpolated(points, pixels, 14).collect()
    assert len(got) == 500 and all(abs(r.altitude - (100.1 + r.point_id % 50 / 100)) < 1e-6 for r in got)
    assert sizes == {"pixels": 4, "squares": 1}


def test_twins_of_a_crowded_cell_equal_all_pairs(spark, monkeypatch):
    """Lines of several lengths side by side, dealt to several tasks; every pair is found once."""
    import math
    import random

    from pathloom.operators import corridors

    monkeypatch.setattr(corridors, "CROWD", 5)
    rng, rows, metre = random.Random(4), [], 1 / 111320
    for k in range(60):
        n, y, x, bend = rng.choice([2, 5, 9, 30, 40]), rng.uniform(0, 120), rng.uniform(0, 150), rng.uniform(-0.3, 0.3)
        line = [(47 + (y + bend * 12 * i) * metre, 5 + (x + 12 * i) * metre / math.cos(math.radians(47))) for i in range(n)]
        rows.append((k, 12.0 * (n - 1) * math.hypot(1, bend) + 15, line))
    edges = spark.createDataFrame(rows, "edge_id long, length_m double, line array<struct<lat:double,lon:double>>")

    def share(points, line):
        step = max(1, -(-len(points) // 16))
        points = points[::step] + ([points[-1]] if points[::step][-1] != points[-1] else [])
        near = 0
        for p in points:
            w = 111320 * math.cos(math.radians(p[0]))
            for a, b in zip(line, line[1:], strict=False):
                ax, ay, dx, dy = (a[1] - p[1]) * w, (a[0] - p[0]) * 111320, (b[1] - a[1]) * w, (b[0] - a[0]) * 111320
                t = max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
                if math.hypot(ax + t * dx, ay + t * dy) < 14:
                    near += 1
                    break
        return near / len(points)

    fit = [r for r in rows if r[1] >= 25]
    want = [(a[0], b[0]) for a in fit for b in fit if a[0] < b[0] and max(a[1], b[1]) <= 2.2 * min(a[1], b[1]) and min(share(a[2], b[2]), share(b[2], a[2])) >= 0.65]
    assert sorted((r.a, r.b) for r in corridors.twins(edges).collect()) == want and len(want) > 10
