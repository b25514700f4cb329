"""Geographic views over the driver's tables: ways, nodes, barriers, edges, traces, requests, candidates.

The tables hold no geography; these views derive it by whole-number arithmetic and one multiplication, the
same in Spark and in DuckDB (``SQL`` has the text for the latter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import geo

#: Fixed values of the views: (divisor, values) of each tag; a way has value (o_orderkey div divisor) % count.
WAY_TAGS: dict[str, tuple[int, tuple[str | None, ...]]] = {
    "highway": (1, ("footway", "pedestrian", "cycleway", "path", "living_street", "residential", "unclassified", "track", "service", "road", "bridleway", "tertiary", "tertiary_link", "secondary", "secondary_link", "steps", "motorway", "primary", "corridor", "trunk")),
    "surface": (20, ("asphalt", None, "ground", "gravel", "grass", None, "mud", "dirt", "sand", "paved", "compacted", "clay")),
    "maxspeed": (7, (None, "50", "80", "FR:rural", "FR:urban", "30 mph", "FR:zone30", "signals")),
    "foot": (3, (None, None, "yes", "designated", "no", None, None)),
    "access": (11, (None, None, None, "private", "yes", "forestry")),
    "sidewalk": (13, (None, "both", "no", None, "left")),
    "lit": (17, (None, "yes", "no")),
    "name": (19, (None, "Rue", None, "")),
    "tracktype": (23, (None, None, "grade1", None, "grade4", "grade2", None)),
    "width": (29, (None, None, "1,5 m", "0.5", None, "1.5m", None, "2", None)),
    "service": (31, (None, None, "alley", "driveway", None)),
    "smoothness": (37, (None, None, "good", "very_bad", "bad", None, None, "horrible", None)),
    "trail_visibility": (41, (None, None, None, "good", "intermediate", None, "bad", None)),
    "informal": (43, (None, None, None, None, None, None, None, "yes")),
    "bicycle": (47, (None, "yes", None)),
}
BARRIER_TAGS: dict[str, tuple[int, tuple[str | None, ...]]] = {
    "barrier": (1, ("gate", "wall", "bollard", "fence", "lift_gate", "hedge", None)),
    "locked": (2, (None, "yes", None, "no")),
    "access": (3, (None, "private", None, "yes", None)),
    "foot": (5, (None, "yes", None, "no", None, None)),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n) if n > 1 else c


def _tags(key: Column, spec: dict) -> Column:
    """A map of the tags that aren't null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.array(*[F.lit(v) for v in values])[(_div(key, n) % len(values)).cast("int")].alias("value")) for k, (n, values) in spec.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _position(key: Column) -> tuple[Column, Column]:
    return (47 + _div(key, 50) * F.lit(0.0016)).alias("lat"), (5 + key % 50 * F.lit(0.0016)).alias("lon")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, lat, lon: the parts on a grid."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.alias("node_id"), *_position(key))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, tags: the orders."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(key.alias("way_id"), _tags(key, WAY_TAGS).alias("tags"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id of the ways of marked routes."""
    return read(spark, sf_dir, "orders").filter("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("way_id"))


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, tags of the barrier nodes."""
    return read(spark, sf_dir, "part").filter("p_partkey % 37 = 0").select(F.col("p_partkey").alias("node_id"), _tags(F.col("p_size"), BARRIER_TAGS).alias("tags"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node_id: the parts of an order in the order of its lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.select(F.col("l_orderkey").alias("way_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_partkey").alias("node_id"))


def edge_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps between all consecutive lines of every order: way_id, pos, src, dst, length_m, cost, highway, quality."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("way_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"),
        F.col("l_quantity").alias("length_m"), (1 + F.col("l_linenumber") / 4).alias("cost"), F.col("l_linestatus").alias("highway"), F.col("l_linenumber").cast("string").alias("quality"),
    )
    return out.filter("dst is not null and src <> dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: the multigraph of all consecutive parts of every order."""
    return edge_steps(spark, sf_dir).select("src", "dst")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, seq, lat, lon, altitude: the events of a user as a walk on a grid."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.col("event_id") % 4
    dy = F.when(turn == 0, 1).when(turn == 2, -1).otherwise(0)
    dx = F.when(turn == 1, 1).when(turn == 3, -1).otherwise(0)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"),
        (F.row_number().over(by_time) - 1).cast("long").alias("seq"),
        (47 + F.sum(dy).over(so_far) * F.lit(0.0002)).alias("lat"),
        (5 + F.sum(dx).over(so_far) * F.lit(0.0003)).alias("lon"),
        F.col("value").alias("altitude"),
    )


#: Of ``terrain``: its zoom, the pixel at 47 N 5 E, parts in a row, pixels of a side of a part.
ZOOM, PIXEL_X, PIXEL_Y, ACROSS, SIDE = 14, 2155406, 1475247, 14, 8


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y (pixel of the whole world at ZOOM) and altitude: a square of pixels for each part, rows of squares around the start of ``traces``.

    Traces that walk off the rows to the east or the west leave the known terrain.
    """
    key = F.col("p_partkey")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # parts are few, pixels many
    parts = read(spark, sf_dir, "part").repartition(tasks, "p_partkey").select(key, "p_size", (key % ACROSS - ACROSS // 2).alias("column"), _div(key, ACROSS).alias("nth"))
    row = F.floor((F.col("nth") + 1) / 2) * F.when(F.col("nth") % 2 == 0, 1).otherwise(-1)
    each = parts.withColumns({"row": row, "i": F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))})
    each = each.select("p_size", (PIXEL_X + F.col("column") * SIDE + F.col("i") % SIDE).alias("x"), (PIXEL_Y + F.col("row") * SIDE + F.floor(F.col("i") / SIDE)).alias("y"))
    return each.select("x", "y", (250 + (F.col("x") * 13 + F.col("y") * 7) % 97 / 4 + F.col("p_size") / 2).alias("altitude"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, candidate_id, length_m, repeated_m, turns, target_m."""
    key, length = F.col("o_orderkey"), F.col("o_totalprice") / 40
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"), key.alias("candidate_id"), length.alias("length_m"),
        (length * (key % 30) / 100).alias("repeated_m"), ((key % 7) / 2).alias("turns"), F.lit(5000.0).alias("target_m"),
    )


def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, step, edge_id, highway, quality, length_m, corridor_id."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route_id"), (F.row_number().over(order) - 1).alias("step"), F.col("l_partkey").alias("edge_id"),
        F.col("l_returnflag").alias("highway"), F.col("l_linestatus").alias("quality"), F.col("l_quantity").alias("length_m"), F.floor(F.col("l_partkey") / 2).alias("corridor_id"),
    )


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, u, v, length_m, weight: most of the steps between neighbours on the grid of ``nodes``."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("u"), F.col("p_size").alias("size"))
    lat, lon = _position(F.col("u"))
    here = parts.select("u", "size", lat, lon)
    way = F.explode(F.array(F.when((F.col("u") % 50 < 49) & (F.col("u") * 7 % 13 != 0), F.lit(1)), F.when(F.col("u") * 11 % 17 != 0, F.lit(50))))
    steps = here.withColumn("way", way).filter("way is not null").withColumn("v", F.col("u") + F.col("way"))
    there = here.select(F.col("u").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    length = geo.great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    out = steps.join(there, "v").withColumn("length_m", length)
    return out.select((F.col("u") * 2 + (F.col("way") == 50).cast("long")).alias("edge_id"), "u", "v", "length_m", (F.col("length_m") * (1 + F.col("size") % 5 / 10)).alias("weight"))


def _lane_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v and the places of both of lanes off the streets: spurs of one to nine steps, small islands, islands far off."""
    key = F.col("p_partkey")
    lat, lon = _position(key)
    parts = read(spark, sf_dir, "part").select(key.alias("p"), lat, lon)
    p, y, x = F.col("p"), F.col("lat") + 0.0003, F.col("lon") + 0.0003
    spur = parts.filter("p % 23 = 0").withColumn("j", F.explode(F.sequence(F.lit(1), (1 + p % 9).cast("int"))))
    name = lambda j: F.lit(1_000_000_000) + p * 16 + j
    first, step = F.col("j") == 1, lambda j: x + (j - 1) * F.lit(0.0016)
    spurs = spur.select(F.when(first, p).otherwise(name(F.col("j") - 1)).alias("u"), name(F.col("j")).alias("v"), F.when(first, F.col("lat")).otherwise(y).alias("lat1"), F.when(first, F.col("lon")).otherwise(step(F.col("j") - 1)).alias("lon1"), y.alias("lat2"), step(F.col("j")).alias("lon2"))
    island = lambda where, base, up: parts.filter(where).select((F.lit(base) + 2 * p).alias("u"), (F.lit(base + 1) + 2 * p).alias("v"), (y + up).alias("lat1"), x.alias("lon1"), (y + up).alias("lat2"), (x + 0.0001).alias("lon2"))
    return spurs.unionByName(island("p % 41 = 5", 2_000_000_000, 0.0)).unionByName(island("p % 53 = 7", 3_000_000_000, 1.0))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets and the lanes off them, with the columns of ``streets``."""
    length = geo.great_circle(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    off = _lane_ends(spark, sf_dir).select((F.lit(4_000_000_000) + F.col("v")).alias("edge_id"), "u", "v", length.alias("length_m"), (length * 1.2).alias("weight"))
    return streets(spark, sf_dir).unionByName(off)


def lane_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of ``lanes``."""
    ends = _lane_ends(spark, sf_dir)
    off = [ends.select(F.col(n).alias("node_id"), F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon")) for k, n in ((1, "u"), (2, "v"))]
    return nodes(spark, sf_dir).unionByName(off[0].unionByName(off[1]).filter("node_id >= 1000000000").distinct())


def outings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, some of them far from all streets."""
    return requests(spark, sf_dir).withColumn("lat", F.col("lat") + F.when((F.col("request_id") % 53).isin(7, 8), 1.0).otherwise(0.0))


def excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``outings`` with an end: end_lat, end_lon; some ends far from all streets, some distances short."""
    key = F.col("request_id")
    shifted = lambda c, n: (F.col(c) + (n + key % 3) * F.lit(0.0016)).alias(f"end_{c}")
    far = (shifted("lat", 3) + F.when(key % 59 == 9, 2.0).otherwise(0.0)).alias("end_lat")
    return outings(spark, sf_dir).select("request_id", "lat", "lon", far, shifted("lon", 2), (F.lit(0.5) + key % 5).alias("km"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with an end: request_id, lat, lon, end_lat, end_lon, km."""
    key = F.col("request_id")
    shifted = lambda c, n, step: (F.col(c) + (n + key % 3) * F.lit(step)).alias(f"end_{c}")
    return requests(spark, sf_dir).select("request_id", "lat", "lon", shifted("lat", 3, 0.0016), shifted("lon", 2, 0.0016), (F.lit(0.5) + key % 5).alias("km"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, lat, lon, km, level."""
    key = F.col("c_custkey")
    lat, lon = _position(key)
    level = F.array(*[F.lit(x) for x in ("strict", "normal", "tolerant")])[(key % 3).cast("int")]
    return read(spark, sf_dir, "customer").select(key.alias("request_id"), (lat + 0.0003).alias("lat"), (lon + 0.0003).alias("lon"), (3 + key % 8).cast("double").alias("km"), level.alias("level"))


def _sql_tag(key: str, spec: tuple[int, tuple[str | None, ...]]) -> str:
    values = ", ".join("NULL" if v is None else f"'{v}'" for v in spec[1])
    return f"([{values}])[1 + ({key} // {spec[0]}) % {len(spec[1])}]"


def _sql_tags(key: str, spec: dict) -> str:
    return ", ".join(f'{_sql_tag(key, s)} AS "{k}"' for k, s in spec.items())


_LINE_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_D = "CAST({} AS DOUBLE)".format
#: Metres between the places of a and b.
LENGTH = "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
_LENGTH_OF_LANE = LENGTH.replace("a.lat", "lat1").replace("b.lat", "lat2").replace("a.lon", "lon1").replace("b.lon", "lon2")
#: DuckDB text of the views, as common table expressions by name; tags are columns there.
SQL = {
    "nodes": f"SELECT p_partkey AS node_id, 47 + (p_partkey // 50) * {_D('0.0016')} AS lat, 5 + (p_partkey % 50) * {_D('0.0016')} AS lon FROM part",
    "ways": f"SELECT o_orderkey AS way_id, {_sql_tags('o_orderkey', WAY_TAGS)} FROM orders",
    "marked": "SELECT o_orderkey AS way_id FROM orders WHERE o_custkey % 10 = 0",
    "barriers": f"SELECT p_partkey AS node_id, {_sql_tags('p_size', BARRIER_TAGS)} FROM part WHERE p_partkey % 37 = 0",
    "way_nodes": f"SELECT l_orderkey AS way_id, row_number() OVER ({_LINE_ORDER}) - 1 AS pos, l_partkey AS node_id FROM lineitem",
    "edges": f"SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER ({_LINE_ORDER}) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst",
    "edge_steps": f"""SELECT * FROM (SELECT l_orderkey AS way_id, row_number() OVER w - 1 AS pos, l_partkey AS src, lead(l_partkey) OVER w AS dst, l_quantity AS length_m,
        1 + l_linenumber / 4::DOUBLE AS cost, l_linestatus AS highway, CAST(l_linenumber AS VARCHAR) AS quality FROM lineitem
        WINDOW w AS ({_LINE_ORDER})) WHERE dst IS NOT NULL AND src <> dst""",
    "traces": f"""SELECT user_id AS trace_id, row_number() OVER w - 1 AS seq,
        47 + CAST(sum(CASE event_id % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) OVER f AS DOUBLE) * {_D('0.0002')} AS lat,
        5 + CAST(sum(CASE event_id % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER f AS DOUBLE) * {_D('0.0003')} AS lon, value AS altitude
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "terrain": f"""SELECT x, y, 250 + (x * 13 + y * 7) % 97 / {_D('4')} + p_size / {_D('2')} AS altitude FROM (SELECT p_size, {PIXEL_X} + (p_partkey % {ACROSS} - {ACROSS // 2}) * {SIDE} + i % {SIDE} AS x,
        {PIXEL_Y} + (nth + 1) // 2 * (CASE nth % 2 WHEN 0 THEN 1 ELSE -1 END) * {SIDE} + i // {SIDE} AS y FROM (SELECT *, p_partkey // {ACROSS} AS nth FROM part), range({SIDE * SIDE}) t(i))""",
    "candidates": f"""SELECT o_custkey AS request_id, o_orderkey AS candidate_id, o_totalprice / 40 AS length_m, o_totalprice / 40 * (o_orderkey % 30) / 100 AS repeated_m,
        (o_orderkey % 7) / {_D('2')} AS turns, {_D('5000')} AS target_m FROM orders""",
    "path_steps": f"""SELECT l_orderkey AS route_id, row_number() OVER ({_LINE_ORDER}) - 1 AS step, l_partkey AS edge_id, l_returnflag AS highway,
        l_linestatus AS quality, l_quantity AS length_m, l_partkey // 2 AS corridor_id FROM lineitem""",
    "streets": f"""SELECT a.u * 2 + (s.way = 50)::BIGINT AS edge_id, a.u, b.u AS v, {LENGTH} AS length_m, {LENGTH} * (1 + a.size % 5 / 10::DOUBLE) AS weight
        FROM (SELECT p_partkey AS u, p_size AS size, 47 + (p_partkey // 50) * {_D('0.0016')} AS lat, 5 + (p_partkey % 50) * {_D('0.0016')} AS lon FROM part) a,
        (VALUES (1), (50)) s(way), (SELECT p_partkey AS u, 47 + (p_partkey // 50) * {_D('0.0016')} AS lat, 5 + (p_partkey % 50) * {_D('0.0016')} AS lon FROM part) b
        WHERE b.u = a.u + s.way AND ((s.way = 1 AND a.u % 50 < 49 AND a.u * 7 % 13 <> 0) OR (s.way = 50 AND a.u * 11 % 17 <> 0))""",
    "lane_ends": f"""SELECT CASE WHEN j = 1 THEN node_id ELSE 1000000000 + node_id * 16 + j - 1 END AS u, 1000000000 + node_id * 16 + j AS v, CASE WHEN j = 1 THEN lat ELSE lat + {_D('0.0003')} END AS lat1,
        CASE WHEN j = 1 THEN lon ELSE lon + {_D('0.0003')} + (j - 2) * {_D('0.0016')} END AS lon1, lat + {_D('0.0003')} AS lat2, lon + {_D('0.0003')} + (j - 1) * {_D('0.0016')} AS lon2
        FROM (SELECT *, unnest(range(1, 2 + node_id % 9)) AS j FROM nodes WHERE node_id % 23 = 0)
        UNION ALL SELECT base + 2 * node_id, base + 1 + 2 * node_id, lat + {_D('0.0003')} + up, lon + {_D('0.0003')}, lat + {_D('0.0003')} + up, lon + {_D('0.0003')} + {_D('0.0001')}
        FROM nodes JOIN (VALUES (41, 5, 2000000000, {_D('0')}), (53, 7, 3000000000, {_D('1')})) i(every, rest, base, up) ON node_id % every = rest""",
    "lanes": f"""SELECT edge_id, u, v, length_m, weight FROM streets UNION ALL SELECT 4000000000 + v, u, v, length_m, length_m * {_D('1.2')} FROM (SELECT u, v, {_LENGTH_OF_LANE} AS length_m FROM lane_ends)""",
    "lane_nodes": """SELECT node_id, lat, lon FROM nodes UNION ALL SELECT * FROM (SELECT u, lat1, lon1 FROM lane_ends WHERE u >= 1000000000 UNION SELECT v, lat2, lon2 FROM lane_ends)""",
    "outings": f"SELECT request_id, lat + CASE WHEN request_id % 53 IN (7, 8) THEN {_D('1')} ELSE {_D('0')} END AS lat, lon, km FROM requests",
    "requests": f"""SELECT c_custkey AS request_id, 47 + (c_custkey // 50) * {_D('0.0016')} + {_D('0.0003')} AS lat, 5 + (c_custkey % 50) * {_D('0.0016')} + {_D('0.0003')} AS lon,
        CAST(3 + c_custkey % 8 AS DOUBLE) AS km, (['strict', 'normal', 'tolerant'])[1 + c_custkey % 3] AS level FROM customer""",
}


def with_views(*names: str, sql: str) -> str:
    """``sql`` after the named views."""
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH RECURSIVE {head}{sql}" if sql.lstrip().startswith(",") else f"WITH {head}\n{sql}"
