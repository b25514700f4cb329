"""Map extracts and requests read, documents and networks written, altitudes between pixels of a known terrain."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators import relief
from pathloom.sources import files

ELEMENTS = [
    {"type": "way", "id": 1, "tags": {"highway": "path"}, "nodes": [10, 11], "geometry": [{"lat": 47.0, "lon": 5.0}, {"lat": 47.1, "lon": 5.1}]},
    {"type": "way", "id": 2, "nodes": [11, 12]},
    {"type": "node", "id": 10, "tags": {"barrier": "gate", "locked": "yes"}},
    {"type": "node", "id": 11, "tags": {"highway": "crossing"}},
    {"type": "relation", "id": 5, "tags": {"route": "hiking"}, "members": [{"type": "way", "ref": 1}, {"type": "node", "ref": 10}, {"type": "way", "ref": 1}]},
    {"type": "relation", "id": 6, "tags": {"route": "bus"}, "members": [{"type": "way", "ref": 2}]},
]


@pytest.mark.parametrize("by_line", [False, True])
def test_extracts(spark, tmp_path, by_line):
    if by_line:
        (tmp_path / "a.json").write_text("\n".join(map(json.dumps, ELEMENTS)))
        found = files.element_lines(spark, str(tmp_path))
    else:
        for k in range(2):
            (tmp_path / f"{k}.json").write_text(json.dumps({"version": 0.6, "elements": ELEMENTS[k::2]}, indent=1))
        found = files.elements(spark, str(tmp_path))
    assert found.count() == len(ELEMENTS)
    ways = {r.way_id: r for r in files.ways(found).collect()}
    assert ways[1].tags == {"highway": "path"} and ways[1].nodes == [10, 11] and ways[1].geometry[1].lon == 5.1
    assert ways[2].tags == {} and ways[2].geometry is None
    assert [r.way_id for r in files.marked_ways(found).collect()] == [1]
    assert [(r.node_id, r.tags["locked"]) for r in files.barriers(found).collect()] == [(10, "yes")]


def test_requests_have_defaults(spark):
    read = spark.createDataFrame([(1, 5.0, None), (2, None, "strict")], "request_id long, km double, level string")
    got = {r.request_id: r for r in files.requests(read).collect()}
    assert (got[1].km, got[1].level, got[1].headings) == (5.0, "normal", 16) and (got[2].km, got[2].level, got[2].most_points) == (8.0, "strict", 3000)


def test_documents_and_networks_are_written(spark, tmp_path):
    traces = spark.createDataFrame([(1, 0, 47.0, 5.0), (1, 1, 47.2, 5.7), (2, 0, -47.0, 5.0)], "trace_id long, seq int, lat double, lon double")
    files.write_documents(files.gpx(traces, F.concat(F.lit("A & "), F.col("trace_id"))), "gpx", f"{tmp_path}/gpx")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/gpx/trace_id=1", wholetext=True).collect())
    assert text.count("<trkpt") == 2 and '<trkpt lat="47.200000" lon="5.700000">' in text and "<name>A &amp; 1</name>" in text
    files.write_network(traces, f"{tmp_path}/network")
    back = spark.read.parquet(f"{tmp_path}/network")
    assert back.count() == 3 and back.select("zone").distinct().count() == 3
    assert back.filter("zone = '94_10'").select("trace_id", "seq").collect() == [(1, 0)]


def test_altitudes_of_a_plane_are_exact(spark):
    """On a terrain that rises evenly with the pixels, the altitude between pixels is that of the plane."""
    zoom, points = 12, [(1, 47.01, 5.02), (2, 47.013, 5.017), (3, 47.0, 5.0), (4, 40.0, 5.0)]
    asked = spark.createDataFrame(points, "point_id long, lat double, lon double")
    x, y = geo.world_pixel(F.col("lat"), F.col("lon"), zoom)
    at = {r.point_id: (r.x, r.y) for r in asked.select("point_id", x.alias("x"), y.alias("y")).collect()}
    left, top = (int(min(at[k][i] for k in (1, 2, 3))) - 2 for i in (0, 1))
    pixels = [(left + i, top + j, 100 + 2.0 * i - 0.5 * j) for i in range(80) for j in range(80)]
    got = {r.point_id: r.altitude for r in relief.interpolated(asked, spark.createDataFrame(pixels, "x long, y long, altitude double"), zoom).collect()}
    for k in (1, 2, 3):
        assert got[k] == pytest.approx(100 + 2.0 * (at[k][0] - 0.5 - left) - 0.5 * (at[k][1] - 0.5 - top))
    assert got[4] is None
