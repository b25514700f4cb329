"""Traces in blocks give what whole traces give: one trace with a third of all points, short ones, gaps, a zone-wise network."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import blocks, relief, traces
from pathloom.sources import files

SIZE = 50


@pytest.fixture(scope="module")
def walked(spark):
    rng = random.Random(2)
    rows = []
    for trace, n in [(1, 900), (2, 1), (3, 2), (4, 49), (5, 50), (6, 51), (7, 400), (8, 300), (None, 30), (9, 3)]:
        lat, lon, height = 47.0, 5.0, 200.0
        for k in range(n):
            lat, lon = lat + rng.choice([-1, 0, 1]) * 0.0002, lon + rng.choice([-1, 0, 1]) * 0.0003
            height = 300.0 if trace == 7 else height + rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0])
            rows.append((trace, k * 3 + 1, lat, lon, None if (trace, k) == (8, 222) else height))
    rows += [(10, k, 47.0 + k * 1e-5, 5.0, float(k)) for k in range(120)]  # climbs all the way
    return spark.createDataFrame(rows, "trace_id long, seq long, lat double, lon double, altitude double").repartition(6)


def table(df, *columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns or df.columns)) for r in df.collect()), key=str)


def test_places_and_halo(walked):
    points = blocks.indexed(walked, SIZE)
    got = {(r.trace_id, r.seq): (r.i, r.block) for r in points.collect()}
    assert got[1, 1] == (0, 0) and got[1, 2698] == (899, 17) and got[6, 151] == (50, 1)
    haloed = blocks.with_halo(points, 2, 1, SIZE).filter("trace_id = 6").groupBy("block", "halo").agg(F.sort_array(F.collect_list("i")).alias("i")).collect()
    assert {(r.block, r.halo): (r.i[0], r.i[-1], len(r.i)) for r in haloed} == {(0, False): (0, 49, 50), (1, False): (50, 50, 1), (1, True): (48, 49, 2), (0, True): (50, 50, 1)}


def test_measures_climbs_and_smoothing(walked):
    named = walked.filter("trace_id is not null")
    columns = ("trace_id", "seq", "cum_m", "n", "total_m", "closed")
    assert table(blocks.measured(named, traces.CLOSED_M, SIZE), *columns) == table(traces._measured(named), *columns)
    want = table(relief._climbs(named, 3.0))
    assert table(blocks.climbs(named, lambda a, r: relief._climb(a, 3.0, r), SIZE)) == want and len(want) == 9
    assert table(blocks.smoothed(named, 3, SIZE)) == table(relief._smoothed(named, 3))


def test_long_traces_take_the_blocks(walked, monkeypatch):
    named = walked.filter("trace_id is not null")
    want = table(traces.summary(named)), table(relief.climbs(named)), table(relief.smoothed(named))
    monkeypatch.setattr(blocks, "LONG", 120)
    monkeypatch.setattr(blocks, "BLOCK", SIZE)
    assert {r.trace_id for r in blocks.long_ones(named).collect()} == {1, 7, 8}
    assert (table(traces.summary(named)), table(relief.climbs(named)), table(relief.smoothed(named))) == want


def test_slopes_turns_and_marks_in_blocks(walked, monkeypatch):
    """Spans that reach over several blocks, a place where a device stays for more than a block, and gaps."""
    named = walked.filter("trace_id is not null")
    still = named.filter("trace_id = 1").withColumns({"trace_id": F.lit(11).cast("long"), "lat": F.when(F.col("seq").between(300, 900), 47.0).otherwise(F.col("lat")), "lon": F.when(F.col("seq").between(300, 900), 5.0).otherwise(F.col("lon"))})
    both = named.unionByName(still)
    at = traces.measured(both).withColumnRenamed("cum_m", "distance_m")
    wanted = lambda: [table(f(at)) for f in (relief.slope_classes, relief.span_slopes, lambda df: relief.span_slopes(df, 3000.0))] + [table(f(both)) for f in (relief.resampled, traces.sharp_turns, lambda df: traces.thinned(df, 20))]
    want = wanted()
    monkeypatch.setattr(blocks, "LONG", 45)
    monkeypatch.setattr(blocks, "BLOCK", SIZE)
    assert wanted() == want and all(want)
    with pytest.raises(ValueError):
        relief.span_slopes(at, 0.0)


def test_span_slopes_are_those_of_the_definition(spark):
    rng = random.Random(5)
    rows = []
    for trace in range(4):
        d = 0.0
        for k in range(130):
            rows.append((trace, k, d, rng.uniform(0, 50)))
            d += rng.choice([0.0, 0.0, 3.0, 25.0, 60.0, 200.0])
    samples = spark.createDataFrame(rows, "trace_id long, seq long, distance_m double, altitude double")
    want = {}
    for trace in range(4):
        mine = [r for r in rows if r[0] == trace]
        for (_, k, d, _), (_, _, d2, _) in zip(mine, mine[1:]):
            middle = (d + d2) / 2
            a = max((r for r in mine if r[2] <= middle - 75), key=lambda r: r[1], default=mine[0])
            b = min((r for r in mine if r[2] >= middle + 75), key=lambda r: r[1], default=mine[-1])
            want[trace, k] = round((b[3] - a[3]) / (b[2] - a[2]) * 100, 6) if b[2] > a[2] else 0.0
    for got in (relief.span_slopes(samples), relief._blocked_slopes(samples, 150.0, 16)):
        assert {(r.trace_id, r.seq): round(r.slope_pct, 6) for r in got.collect()} == want


def test_documents_in_pieces(spark, walked, tmp_path):
    named = walked.filter("trace_id is not null")
    title = F.concat(F.lit("A & B "), F.col("trace_id").cast("string"))
    for pieces, whole, text in ((files.gpx_pieces(named, title, SIZE), files.gpx(named, title), "gpx"), (files.geojson_pieces(named, SIZE), files.geojson(named), "geojson")):
        rows = pieces.collect()
        joined = {}
        for r in sorted(rows, key=lambda r: (r.trace_id, r.piece)):
            joined[r.trace_id] = joined.get(r.trace_id, "") + r.text
        assert joined == {r.trace_id: r[text] for r in whole.collect()} and max(r.piece for r in rows) == 17
    files.write_pieces(files.geojson_pieces(named, SIZE), f"{tmp_path}/out")
    parts = sorted(glob.glob(f"{tmp_path}/out/trace_id=1/piece=*/part-*"))
    whole = json.loads("".join(open(p).read() for p in parts))
    assert len(parts) == 18 and len(whole["geometry"]["coordinates"]) == 900


def test_a_stored_network_is_read_by_zones(spark, tmp_path):
    rows = [(k, 47.0 + k * 0.1, 5.0 + k % 7 * 0.3) for k in range(60)]
    files.write_network(spark.createDataFrame(rows, "edge_id long, lat double, lon double"), f"{tmp_path}/net")
    areas = spark.createDataFrame([(48.0, 5.9, 20_000.0), (50.0, 5.6, 1000.0)], "lat double, lon double, radius_m double")
    got = files.read_network(spark, f"{tmp_path}/net", areas)
    zones = {r.zone for r in got.select("zone").distinct().collect()}
    inside = [k for k, y, x in rows if any(abs(y - a) <= r / 111_320 and abs(x - b) <= r / 70_000 for a, b, r in ((48.0, 5.9, 20_000.0), (50.0, 5.6, 1000.0)))]
    assert set(inside) <= {r.edge_id for r in got.collect()} and 0 < len(zones) < 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [zone" in plan or "PartitionFilters: [isnotnull(zone" in plan or "zone#" in plan.split("PartitionFilters")[1][:80]
