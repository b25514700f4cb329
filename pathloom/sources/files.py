"""Reading map extracts and requests, writing traces as GPX and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.functions.geo import terrain_metres
from pathloom.functions.parse import xml_text
from pathloom.operators import blocks

ELEMENT = (
    "type string, id long, tags map<string,string>, nodes array<long>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,ref:long>>"
)
ROUTES = ("hiking", "foot", "walking", "running")
#: What a request leaves out (fixed values).
DEFAULTS = {"km": 8.0, "level": "normal", "headings": 16, "tolerance": 0.05, "most_repeated": 0.12, "most_points": 3000}
LICENCE = "https://opendatacommons.org/licenses/odbl/"


def elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of JSON map extracts, one extract a file: each file is one task's, so cut large extracts up."""
    return spark.read.schema(f"elements array<struct<{ELEMENT}>>").json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def element_lines(spark: SparkSession, path: str) -> DataFrame:
    """The elements of JSON files with one element a line; such files are split between tasks."""
    return spark.read.schema(ELEMENT).json(path)


def ways(found: DataFrame) -> DataFrame:
    return found.filter("type = 'way'").select(F.col("id").alias("way_id"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), "nodes", "geometry")


def marked_ways(found: DataFrame) -> DataFrame:
    """way_id of the members of marked routes, once each."""
    routes = found.filter((F.col("type") == "relation") & F.col("tags")["route"].isin(*ROUTES))
    return routes.select(F.explode("members").alias("m")).filter("m.type = 'way'").select(F.col("m.ref").alias("way_id")).distinct()


def barriers(found: DataFrame) -> DataFrame:
    return found.filter((F.col("type") == "node") & F.col("tags")["barrier"].isNotNull()).select(F.col("id").alias("node_id"), "tags")


def terrain(spark: SparkSession, path: str) -> DataFrame:
    """zoom, x, y (pixel of the whole world) and altitude of the terrain images ``<zoom>/<column>/<row>.png`` under ``path``.

    Files that are no images are left out: where a tile is missing, the terrain is unknown. An image is 65,536 rows, made inside its row.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    part = lambda k: F.regexp_extract("origin", r"(\d+)/(\d+)/(\d+)\.[A-Za-z]+$", k).cast("long")
    size = F.col("nChannels")
    # the channels are blue, green, red and perhaps alpha; a grey image has one
    bytes_of = lambda i: F.hex(F.substring("data", i * size + 1, F.least(size, F.lit(3))))
    code = lambda i: F.conv(F.when(size == 1, F.repeat(bytes_of(i), F.lit(3))).otherwise(bytes_of(i)), 16, 10).cast("int")
    pixels = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: F.struct(i.alias("i"), code(i).alias("c")))
    each = images.select(part(1).cast("int").alias("zoom"), part(2).alias("column"), part(3).alias("row"), "width", "height", F.explode(pixels).alias("p"))
    red, green, blue = (F.col("p.c").bitwiseAND(255), F.shiftright(F.col("p.c"), 8).bitwiseAND(255), F.shiftright(F.col("p.c"), 16))
    x, y = F.col("column") * F.col("width") + F.col("p.i") % F.col("width"), F.col("row") * F.col("height") + F.floor(F.col("p.i") / F.col("width"))
    return each.select("zoom", x.alias("x"), y.alias("y"), terrain_metres(red, green, blue).alias("altitude"))


def requests(read: DataFrame) -> DataFrame:
    """``read`` with the defaults where an option is missing or null."""
    for name, value in DEFAULTS.items():
        given = F.col(name) if name in read.columns else F.lit(None)
        read = read.withColumn(name, F.coalesce(given, F.lit(value)))
    return read


def display_name(km: Column, laps: Column, when: Column) -> Column:
    """What a watch shows: distance, laps if more than one, date."""
    return F.concat(F.lit("Loop "), F.format_string("%.1f", km), F.lit(" km"), F.when(laps > 1, F.concat(F.lit(" x"), laps.cast("string"))).otherwise(""), F.lit(" of "), F.date_format(when, "dd/MM/yyyy"))


def file_names(rows: DataFrame, km: str, when: str) -> DataFrame:
    """``rows`` with file: date, time and distance, and a number where several would have one name."""
    stem = F.concat(F.date_format(when, "yyyy-MM-dd_HH'h'mm"), F.lit("_"), F.format_string("%.1fkm", F.col(km)))
    others = [c for c in rows.columns]
    nth = F.row_number().over(Window.partitionBy("_stem").orderBy(*others)) - 1
    named = rows.withColumn("_stem", stem).withColumn("_n", nth)
    return named.withColumn("file", F.concat("_stem", F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit(".gpx"))).drop("_stem", "_n")


def _points(traces: DataFrame, line: Column, between: str) -> DataFrame:
    """trace_id and the lines of all points in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return traces.groupBy("trace_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), between).alias("_points"))


def _gpx_frame(name: Column) -> tuple[Column, str]:
    """What stands before and after the points of a GPX document."""
    title = F.concat(F.lit("    <name>"), xml_text(name), F.lit("</name>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="pathloom" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>'
    licence = f'    <copyright author="OpenStreetMap contributors">\n      <license>{LICENCE}</license>\n    </copyright>\n  </metadata>\n  <trk>'
    return F.concat_ws("\n", F.lit(head), title, F.lit(licence), title, F.lit("    <trkseg>\n")), "\n    </trkseg>\n  </trk>\n</gpx>\n"


_GEOJSON = ('{"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [', "]}}")


def _gpx_point() -> Column:
    return F.format_string('      <trkpt lat="%.6f" lon="%.6f"></trkpt>', "lat", "lon")


def _geojson_point() -> Column:
    return F.format_string("[%.6f, %.6f]", "lon", "lat")


def gpx(traces: DataFrame, name: Column) -> DataFrame:
    """trace_id and gpx: one GPX 1.1 document per trace, six decimals, with the licence of the map data.

    ``name`` is a column over trace_id; it is escaped. A document is one value; ``gpx_pieces`` gives it in rows.
    """
    head, tail = _gpx_frame(name)
    return _points(traces, _gpx_point(), "\n").select("trace_id", F.concat(head, F.col("_points"), F.lit(tail)).alias("gpx"))


def geojson(traces: DataFrame) -> DataFrame:
    """trace_id and geojson: a Feature with a LineString, longitude first."""
    return _points(traces, _geojson_point(), ", ").select("trace_id", F.concat(F.lit(_GEOJSON[0]), F.col("_points"), F.lit(_GEOJSON[1])).alias("geojson"))


def gpx_pieces(traces: DataFrame, name: Column, block: int | None = None) -> DataFrame:
    """trace_id, piece, text: the documents of ``gpx`` cut into rows of a block of points, for traces of any length."""
    head, tail = _gpx_frame(name)
    return blocks.pieces(traces, _gpx_point(), head, tail, "\n", block)


def geojson_pieces(traces: DataFrame, block: int | None = None) -> DataFrame:
    """trace_id, piece, text: the documents of ``geojson`` cut into rows of a block of points."""
    return blocks.pieces(traces, _geojson_point(), F.lit(_GEOJSON[0]), _GEOJSON[1], ", ", block)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """A folder for each trace with its pieces in folders in the order of their names. Read one after another they are the
    document, with a line break after each piece, where both formats allow white space."""
    dealt = pieces.select("trace_id", F.format_string("%09d", "piece").alias("piece"), F.col("text").alias("value")).repartition("trace_id", "piece")
    dealt.write.partitionBy("trace_id", "piece").text(path)


def write_documents(documents: DataFrame, text: str, path: str) -> None:
    """One text file for each trace, below a folder of its own."""
    documents.select("trace_id", F.col(text).alias("value")).repartition("trace_id").write.partitionBy("trace_id").option("lineSep", "\n").text(path)


def zone_of(lat: Column, lon: Column, degrees: float = 0.5) -> Column:
    """The zone of a place in a stored network."""
    return F.concat_ws("_", F.round(lat / degrees).cast("int"), F.round(lon / degrees).cast("int"))


def read_network(spark: SparkSession, path: str, areas: DataFrame, degrees: float = 0.5) -> DataFrame:
    """The rows of a stored network in the zones that the boxes of ``areas`` (lat, lon, radius_m) touch; other zones aren't read.

    The zones' names go to the driver: as many as the areas touch.
    """
    box = geo.box(F.col("lat"), F.col("lon"), F.col("radius_m"))
    steps = lambda a, b: F.explode(F.sequence(F.round(a / degrees).cast("int"), F.round(b / degrees).cast("int")))
    rows = areas.select(box.alias("b")).withColumn("r", steps(F.col("b.south"), F.col("b.north"))).withColumn("c", steps(F.col("b.west"), F.col("b.east")))
    zones = [r["zone"] for r in rows.select(F.concat_ws("_", "r", "c").alias("zone")).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("zone").isin(zones))


def write_network(steps: DataFrame, path: str, degrees: float = 0.5) -> None:
    """Keep a derived network by zone (rounded position), so that later jobs read only the zones that they need."""
    steps.withColumn("zone", zone_of(F.col("lat"), F.col("lon"), degrees)).repartition("zone").write.partitionBy("zone").parquet(path)
