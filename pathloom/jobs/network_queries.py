"""Registered queries of the rules, the network and the graph jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import geo, rules
from pathloom.operators import graph, network, spatial
from pathloom.sources import views
from pathloom.sources.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _in(column: str, values) -> str:
    return f"""coalesce({column} IN ({', '.join(f"'{v}'" for v in sorted(values))}), false)"""


_NUMBER = r"'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def _number(text: str) -> str:
    word = rf"replace(regexp_extract({text}, '^\s*(\S+)', 1), ',', '.')"
    return f"CASE WHEN regexp_matches({word}, {_NUMBER}) THEN TRY_CAST({word} AS DOUBLE) END"


_KIND = "lower(trim(regexp_extract(maxspeed, '([^:]*)$', 1)))"
_ZONED = f"CASE WHEN starts_with({_KIND}, 'zone') THEN substr({_KIND}, 5) ELSE {_KIND} END"
_SPEED = f"""CASE WHEN maxspeed IS NULL OR maxspeed = '' THEN NULL WHEN {_KIND} = 'rural' THEN 80.0::DOUBLE WHEN {_KIND} = 'urban' THEN 50.0::DOUBLE
    ELSE ({_number(f'({_ZONED})')}) * CASE WHEN contains(maxspeed, 'mph') THEN 1.609::DOUBLE ELSE 1.0::DOUBLE END END"""
_COSTS = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in rules.BASE_COST.items()) + "}"

#: The ways with their speed, exposure, quality and whether they are marked, at each level.
TAGGED = with_views("ways", "marked", sql=f""", levels AS (SELECT unnest(['strict', 'normal', 'tolerant']) AS lv),
told AS (SELECT w.*, m.way_id IS NOT NULL AS waymarked, {_SPEED} AS speed, {_number('width')} AS wide,
  {_in('highway', rules.SHARED_ROADS)} AS shared, {_in('highway', rules.NATURAL)} AS wild
  FROM ways w LEFT JOIN (SELECT DISTINCT way_id FROM marked) m USING (way_id)),
tagged AS (SELECT *, CASE WHEN {_in('surface', rules.HARD)} OR {_in('tracktype', ('grade1', 'grade2'))} THEN 'hard' WHEN {_in('surface', rules.SOFT | rules.RISKY)} THEN 'soft' ELSE 'unknown' END AS ground,
  CASE WHEN NOT shared OR foot = 'designated' OR {_in('sidewalk', rules.FOOTWAY_SIDES)} THEN NULL WHEN speed >= 70 THEN 'danger'
       WHEN speed IS NOT NULL OR (lit IS NOT NULL AND lit <> 'no') THEN NULL ELSE 'uncertain' END AS exposure FROM told CROSS JOIN levels),
judged AS (SELECT *, CASE
  WHEN NOT {_in('highway', rules.BASE_COST)} THEN 'highway'
  WHEN {_in('foot', ('no', 'private', 'destination'))} THEN 'foot'
  WHEN NOT {_in('foot', rules.FOOT_ALLOWED)} AND {_in('access', rules.CLOSED | rules.LAND_WORK)} THEN 'access'
  WHEN {_in('service', rules.PRIVATE_SERVICE)} AND lv <> 'tolerant' AND NOT {_in('foot', ('yes', 'designated', 'official'))} THEN 'service'
  WHEN exposure = 'danger' AND lv <> 'tolerant' THEN 'danger'
  WHEN informal = 'yes' THEN 'informal'
  WHEN {_in('trail_visibility', ('bad', 'horrible', 'no'))} OR (lv = 'strict' AND trail_visibility = 'intermediate') THEN 'visibility'
  WHEN {_in('smoothness', ('horrible', 'very_horrible', 'impassable'))} OR (lv = 'strict' AND {_in('smoothness', ('bad', 'very_bad'))}) OR (lv <> 'tolerant' AND smoothness = 'very_bad' AND wild) THEN 'smoothness'
  WHEN {_in('tracktype', ('grade4', 'grade5'))} THEN 'tracktype'
  WHEN wide < 0.6 THEN 'width'
  WHEN {_in('surface', rules.FORBIDDEN_SURFACE)} THEN 'surface'
  WHEN {_in('surface', rules.RISKY)} AND lv <> 'tolerant' THEN 'risky_surface'
  WHEN wild AND lv = 'strict' AND ground <> 'hard' THEN 'soft_path'
  WHEN wild AND lv = 'normal' AND ground <> 'hard' AND NOT (coalesce(name, '') <> '' OR waymarked OR coalesce(lit, 'no') <> 'no' OR {_in('trail_visibility', ('excellent', 'good'))}
       OR {_in('bicycle', ('designated', 'yes'))} OR {_in('smoothness', ('excellent', 'good', 'intermediate'))}) THEN 'unproven_path' END AS reason,
  ({_COSTS})[highway] * CASE WHEN ground = 'soft' THEN 1.15::DOUBLE WHEN ground = 'unknown' AND wild THEN 1.45::DOUBLE ELSE 1 END
   * CASE WHEN {_in('trail_visibility', ('excellent', 'good'))} THEN 0.90::DOUBLE ELSE 1 END * CASE WHEN coalesce(name, '') <> '' AND wild THEN 0.95::DOUBLE ELSE 1 END
   * CASE WHEN waymarked THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN {_in('service', rules.PRIVATE_SERVICE)} THEN 2.0::DOUBLE WHEN service = 'alley' THEN 1.3::DOUBLE ELSE 1 END
   * CASE WHEN shared AND {_in('sidewalk', ('no', 'none'))} THEN 1.8::DOUBLE ELSE 1 END * CASE WHEN shared AND speed >= 70 THEN 1.6::DOUBLE ELSE 1 END
   * CASE WHEN shared AND exposure = 'danger' THEN 3.0::DOUBLE WHEN shared AND exposure = 'uncertain' THEN 1.5::DOUBLE ELSE 1 END AS cost,
  CASE WHEN waymarked THEN 'marked' WHEN ground = 'unknown' AND NOT wild THEN 'street' ELSE ground END AS quality FROM tagged)""")

_HAVERSINE = "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))".format
#: Valid ways' steps: way_id, pos, src, dst, length_m.
STEPS = f"""placed AS (SELECT way_id, pos, node_id, lat, lon FROM way_nodes LEFT JOIN nodes USING (node_id)),
fine AS (SELECT way_id FROM placed GROUP BY way_id HAVING count(*) >= 2 AND count(*) = count(lat)),
pairs AS (SELECT way_id, pos, node_id AS src, lat AS alat, lon AS alon, lead(node_id) OVER w AS dst, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon
  FROM placed JOIN fine USING (way_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
steps AS (SELECT way_id, pos, src, dst, {_HAVERSINE(a='a', b='b')} AS length_m FROM pairs WHERE dst IS NOT NULL AND src <> dst)"""
_TAGGED_STEPS = TAGGED.replace("WITH RECURSIVE ", "WITH RECURSIVE " + ", ".join(f"{n} AS ({views.SQL[n]})" for n in ("nodes", "way_nodes", "barriers")) + ", ") + ", " + STEPS
_BLOCKED = f"""blocked AS (SELECT DISTINCT node_id FROM barriers WHERE coalesce(barrier, '') <> '' AND NOT {_in('foot', rules.FOOT_ALLOWED)}
  AND ({_in('foot', ('no', 'private'))} OR locked IS NOT DISTINCT FROM 'yes' OR {_in('access', rules.CLOSED)} OR {_in('barrier', rules.BARRIERS)}))"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.with_nodes(views.ways(spark, sf_dir), views.way_nodes(spark, sf_dir), views.nodes(spark, sf_dir))


def _passable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.passable(_ways(spark, sf_dir), views.marked(spark, sf_dir), views.barriers(spark, sf_dir))


@query(TAGGED + " SELECT way_id, lv AS level, reason FROM judged")
def way_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.judged(views.ways(spark, sf_dir), views.marked(spark, sf_dir)).select("way_id", "level", "reason")


@query(TAGGED + " SELECT way_id, lv AS level, round(cost, 6) AS cost, highway, quality FROM judged WHERE reason IS NULL")
def way_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = network.judged(views.ways(spark, sf_dir), views.marked(spark, sf_dir)).filter("verdict is not null")
    return out.select("way_id", "level", F.round("verdict.cost", 6).alias("cost"), "verdict.highway", "verdict.quality")


@query(TAGGED + " SELECT way_id, speed, wide AS width_m, exposure FROM tagged WHERE lv = 'normal'")
def way_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.prepared(views.ways(spark, sf_dir))
    return out.select("way_id", F.col("_speed").alias("speed"), F.col("_width").alias("width_m"), F.col("_exposure").alias("exposure"))


@query(with_views("barriers", sql=", " + _BLOCKED + " SELECT node_id FROM blocked"))
def blocked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.blocked_nodes(views.barriers(spark, sf_dir))


@query(with_views("nodes", "way_nodes", sql=", " + STEPS + " SELECT way_id, pos, src, dst, round(length_m, 3) AS length_m FROM steps"))
def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = network.segments(_ways(spark, sf_dir).drop("tags"))
    return steps.select("way_id", F.col("pos").cast("long").alias("pos"), "src", "dst", F.round("length_m", 3).alias("length_m"))


@query(_TAGGED_STEPS + ", " + _BLOCKED + """ SELECT lv AS level, kind, label, round(sum(length_m), 2) AS metres FROM (
  SELECT lv, length_m, unnest(['highway', 'quality']) AS kind, unnest([highway, quality]) AS label
  FROM steps JOIN judged USING (way_id) WHERE reason IS NULL AND src NOT IN (SELECT node_id FROM blocked) AND dst NOT IN (SELECT node_id FROM blocked))
GROUP BY lv, kind, label""")
def network_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = network.breakdowns(_passable(spark, sf_dir), ["level"])
    return out.select("level", "kind", "label", F.round("metres", 2).alias("metres"))


@query(TAGGED + """ SELECT lv AS level, coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1, 2
UNION ALL SELECT lv, 'all', count(*) FROM judged GROUP BY lv""")
def way_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.audit(views.ways(spark, sf_dir), views.marked(spark, sf_dir))


def whole(f):
    """Keep the query also under the name that it had while the plain one read a part of the lines."""
    QUERIES[f"whole_{f.__name__}"] = f
    ORACLES[f"whole_{f.__name__}"] = ORACLES[f.__name__]
    return f


@whole
@query(with_views("edges", sql="SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node"))
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(views.edges(spark, sf_dir))


@whole
@query(with_views("edges", sql=""", pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM pairs
  UNION SELECT p.b, min(r.component) FROM reach r JOIN pairs p ON p.a = r.node JOIN recurring.reach AS c ON c.node = p.b WHERE r.component < c.component GROUP BY p.b)
SELECT node, component FROM reach"""))
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir)
    found = graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _peels(rounds: int) -> str:
    """SQL that takes away nodes of degree 1 that often."""
    parts = ["c0 AS (SELECT * FROM edges)"]
    for k in range(rounds):
        parts.append(f"k{k} AS (SELECT node FROM (SELECT src AS node FROM c{k} UNION ALL SELECT dst FROM c{k}) GROUP BY node HAVING count(*) > 1)")
        parts.append(f"c{k + 1} AS (SELECT * FROM c{k} WHERE src IN (SELECT node FROM k{k}) AND dst IN (SELECT node FROM k{k}))")
    return ", ".join(parts) + f" SELECT src, dst, count(*) AS n FROM c{rounds} GROUP BY src, dst"


@whole
@query(with_views("edges", sql=", " + _peels(12)))
def graph_two_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_core(views.edges(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@whole
@query(with_views("edge_steps", "barriers", sql=""", arcs AS (SELECT src, dst, min(length_m) AS m FROM (SELECT src, dst, length_m FROM edge_steps UNION ALL SELECT dst, src, length_m FROM edge_steps) GROUP BY src, dst),
reach(node, cost) USING KEY (node) AS (SELECT DISTINCT node_id, 0::DOUBLE FROM barriers WHERE node_id IN (SELECT src FROM arcs)
  UNION SELECT a.dst, min(r.cost + a.m) FROM reach r JOIN arcs a ON a.src = r.node LEFT JOIN recurring.reach AS c ON c.node = a.dst WHERE c.cost IS NULL OR r.cost + a.m < c.cost GROUP BY a.dst)
SELECT node, round(cost, 3) AS cost FROM reach"""))
def nearest_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest metres from every node to a barrier, over all steps."""
    steps = views.edge_steps(spark, sf_dir)
    ends = steps.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    gates = views.barriers(spark, sf_dir).select(F.lit(0).cast("long").alias("query"), F.col("node_id").alias("node")).join(ends, "node", "left_semi")
    return graph.cheapest(steps.withColumn("weight", F.col("length_m")), gates).select("node", F.round("cost", 3).alias("cost"))


@query(with_views("requests", "nodes", sql=f""", pairs AS (SELECT r.request_id, n.node_id, {_HAVERSINE(a='r.', b='n.')} AS d
  FROM requests r JOIN nodes n ON abs(r.lat - n.lat) < 0.01 AND abs(r.lon - n.lon) < 0.02)
SELECT request_id, node_id, distance_m FROM (SELECT request_id, node_id, round(d, 3) AS distance_m, row_number() OVER (PARTITION BY request_id ORDER BY d, node_id) AS k FROM pairs WHERE d < 400) WHERE k = 1
UNION ALL SELECT request_id, NULL, NULL FROM requests WHERE request_id NOT IN (SELECT request_id FROM pairs WHERE d < 400)"""))
def nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.requests(spark, sf_dir).select(F.col("request_id").alias("point_id"), "lat", "lon")
    out = spatial.nearest(points, views.nodes(spark, sf_dir), 400.0)
    return out.select(F.col("point_id").alias("request_id"), "node_id", F.round("distance_m", 3).alias("distance_m"))


@query(_TAGGED_STEPS + ", " + _BLOCKED + """, arcs AS (SELECT src, dst FROM steps JOIN judged USING (way_id) WHERE lv = 'normal' AND reason IS NULL
  AND src NOT IN (SELECT node_id FROM blocked) AND dst NOT IN (SELECT node_id FROM blocked)), passable AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs)
SELECT way_id, pos, src, dst FROM steps s WHERE NOT EXISTS (SELECT 1 FROM passable b WHERE b.src = s.src AND b.dst = s.dst)""")
def off_network_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of all ways that leave the network which refusals and barriers leave at the normal level."""
    steps = network.segments(_ways(spark, sf_dir).drop("tags"))
    net = network.passable(_ways(spark, sf_dir), views.marked(spark, sf_dir), views.barriers(spark, sf_dir), levels=("normal",))
    return spatial.off_network(steps, net).select("way_id", F.col("pos").cast("long").alias("pos"), "src", "dst")


_X = "(lon + 180) / 360 * 2097152::DOUBLE"
_Y = "(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2097152::DOUBLE"


@query(with_views("nodes", sql=f"SELECT DISTINCT CAST(floor(({_X} + i) / 256) AS BIGINT) AS x, CAST(floor(({_Y} + j) / 256) AS BIGINT) AS y FROM nodes, (VALUES (-1), (1)) a(i), (VALUES (-1), (1)) b(j)"))
def terrain_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.tiles(views.nodes(spark, sf_dir), 13)


@query(with_views("requests", sql=f"""SELECT request_id,
  round({_HAVERSINE(a='', b='0*').replace('0*lat', '47.1').replace('0*lon', '5.1')}, 3) AS distance_m,
  round(fmod(degrees(atan2(sin(radians(5.1 - lon)) * cos(radians(47.1)), cos(radians(lat)) * sin(radians(47.1)) - sin(radians(lat)) * cos(radians(47.1)) * cos(radians(5.1 - lon)))) + 360, 360), 6) AS heading,
  round(sqrt(pow((47.1 - lat) * 111320, 2) + pow((5.1 - lon) * 111320 * cos(radians(lat)), 2)), 3) AS planar_m FROM requests"""))
def request_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("lat"), F.col("lon"), F.lit(47.1), F.lit(5.1))
    return views.requests(spark, sf_dir).select("request_id", F.round(geo.great_circle(*at), 3).alias("distance_m"), F.round(geo.bearing(*at), 6).alias("heading"), F.round(geo.planar(*at), 3).alias("planar_m"))


@whole
@query(with_views("edge_steps", sql=""", half AS (SELECT way_id, pos, 0 AS back, src, dst, length_m, cost, highway, quality FROM edge_steps UNION ALL SELECT way_id, pos, 1, dst, src, length_m, cost, highway, quality FROM edge_steps),
joints AS (SELECT src AS node FROM half GROUP BY src HAVING count(*) <> 2),
walk AS (SELECT src AS u, way_id AS fw, pos AS fp, highway, quality, way_id, pos, dst, length_m, length_m * cost AS weight, [src, dst] AS polyline FROM half WHERE src IN (SELECT node FROM joints)
  UNION ALL SELECT k.u, k.fw, k.fp, k.highway, k.quality, h.way_id, h.pos, h.dst, k.length_m + h.length_m, k.weight + h.length_m * h.cost, list_append(k.polyline, h.dst)
  FROM walk k JOIN half h ON h.src = k.dst AND NOT (h.way_id = k.way_id AND h.pos = k.pos) WHERE k.dst NOT IN (SELECT node FROM joints))
SELECT u || '-' || fw || '-' || fp AS edge_id, u, dst AS v, round(length_m, 3) AS length_m, round(weight, 3) AS weight, array_to_string(polyline, ',') AS nodes, highway, quality
FROM walk WHERE dst IN (SELECT node FROM joints) AND (u, fw, fp) <= (dst, way_id, pos)"""))
def contracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.contract(views.edge_steps(spark, sf_dir))
    nodes = F.array_join(F.col("polyline").cast("array<string>"), ",").alias("nodes")
    return out.select("edge_id", "u", "v", F.round("length_m", 3).alias("length_m"), F.round("weight", 3).alias("weight"), nodes, "highway", "quality")
