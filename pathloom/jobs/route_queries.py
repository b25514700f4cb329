"""Registered queries of the route search and of what it is made of, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.jobs.network_queries import TAGGED
from pathloom.operators import choose, graph, labels, network, paths, search, spatial
from pathloom.sources import places, views
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


_BOX = "radius_m / 111320::DOUBLE"
_AREAS = "areas AS (SELECT request_id, lat, lon, km, least(25000::DOUBLE, 0.4::DOUBLE * km * 1000 + 800) AS radius_m FROM requests)"


@query(with_views("requests", "nodes", sql=f""", {_AREAS} SELECT request_id, count(node_id) AS n FROM areas a LEFT JOIN nodes n
  ON n.lat BETWEEN a.lat - {_BOX} AND a.lat + {_BOX} AND n.lon BETWEEN a.lon - {_BOX} / greatest(cos(radians(a.lat)), 0.01) AND a.lon + {_BOX} / greatest(cos(radians(a.lat)), 0.01)
GROUP BY request_id"""))
def request_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes the work area of each request holds."""
    areas = choose.work_areas(views.requests(spark, sf_dir))
    held = spatial.count_in_areas(areas, views.nodes(spark, sf_dir))
    return areas.select("request_id").join(held, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("n"))


_TRIPS = """trips AS (SELECT request_id, lat, lon, lat + (3 + request_id % 3) * 0.0016::DOUBLE AS end_lat, lon + (2 + request_id % 3) * 0.0016::DOUBLE AS end_lon, 0.5::DOUBLE + request_id % 5 AS km FROM requests)"""
_CHORD = "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(end_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(end_lat)) * pow(sin(radians(end_lon - lon) / 2), 2)))"


@query(with_views("requests", sql=f""", {_TRIPS} SELECT request_id, round((lat + end_lat) / 2, 9) AS mid_lat, round((lon + end_lon) / 2, 9) AS mid_lon,
  round(least(25000::DOUBLE, 0.4::DOUBLE * km * 1000 + 800 + {_CHORD} / 2), 3) AS radius_m, round(sqrt(greatest(0, pow(km * 500, 2) - pow({_CHORD} / 2, 2))) * 1.7::DOUBLE + 300, 3) AS highest_m FROM trips"""))
def trip_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work area of each trip from A to B and the most that its arc may rise."""
    areas = choose.work_areas(views.trips(spark, sf_dir)).withColumn("target_m", F.col("km") * 1000)
    grid = search.arc_grid(areas, counts=(1,)).filter("side > 0")
    return grid.select("request_id", F.round("mid_lat", 9).alias("mid_lat"), F.round("mid_lon", 9).alias("mid_lon"), F.round("radius_m", 3).alias("radius_m"), F.round("high", 3).alias("highest_m"))


_FAR = "radians({lat}) AS {p}1, radians({lon}) AS {p}2, {m} / 6371008.8::DOUBLE AS {p}3, radians({a}) AS {p}4".format
_LAT = "asin(sin({p}1) * cos({p}3) + cos({p}1) * sin({p}3) * cos({p}4))".format
_LON = "fmod({p}2 + atan2(sin({p}4) * sin({p}3) * cos({p}1), cos({p}3) - sin({p}1) * {q}) + 3 * pi(), 2 * pi()) - pi()".format


@query(with_views("requests", sql=f""", shapes AS (SELECT h * 22.5::DOUBLE AS heading, corners, off FROM range(16) h(h), (VALUES (3), (4), (5), (6)) c(corners), (VALUES (0), (1)) o(off)),
grid AS (SELECT r.*, s.*, km * 1000 / (2 * corners * sin(pi() / corners)) AS radius FROM requests r, shapes s),
c1 AS (SELECT *, {_FAR(lat='lat', lon='lon', m='radius', a='heading', p='q')} FROM grid),
c2 AS (SELECT *, CASE WHEN off = 1 THEN degrees({_LAT(p='q')}) ELSE lat END AS clat, CASE WHEN off = 1 THEN degrees({_LON(p='q', q='sin(' + _LAT(p='q') + ')')}) ELSE lon END AS clon FROM c1),
c3 AS (SELECT *, unnest(range(off, corners)) AS k FROM c2),
c4 AS (SELECT *, {_FAR(lat='clat', lon='clon', m='radius', a='fmod(heading + 180 * off + k * 360::DOUBLE / corners, 360)', p='p')} FROM c3)
SELECT request_id, heading, corners, off = 1 AS off_centre, k::INT AS k, round(degrees({_LAT(p='p')}), 7) AS lat, round(degrees({_LON(p='p', q='sin(' + _LAT(p='p') + ')')}), 7) AS lon FROM c4"""))
def loop_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of all shapes of loops of each request, at the radius that suits its distance."""
    # requests are few and narrow, corners are many: all tasks get some requests, and the corners stay where they are made
    asked = views.requests(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = asked.withColumns({"target_m": F.col("km") * 1000, "node": F.lit(0)})
    grid = search.loop_grid(held).withColumn("radius_m", F.col("low") / 0.25)
    out = search.loop_points(grid, "request_id", "heading", "corners", "off_centre")
    return out.select("request_id", "heading", "corners", "off_centre", "k", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(with_views("streets", sql=""", pairs AS (SELECT u AS a, v AS b FROM streets UNION SELECT v, u FROM streets),
reach AS (SELECT DISTINCT a AS node, a AS root FROM pairs UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node AND r.root < p.b AND p.b - r.root < 400),
local AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
jump AS (SELECT node, root, 0 AS n FROM local UNION SELECT j.node, l.root, n + 1 FROM jump j JOIN local l ON l.node = j.root WHERE l.root < j.root),
found AS (SELECT node, min(root) AS component FROM jump GROUP BY node),
sizes AS (SELECT component, count(*) AS n_nodes FROM found GROUP BY component),
metres AS (SELECT component, sum(length_m) AS metres FROM streets s JOIN found f ON f.node = s.u GROUP BY component)
SELECT node, component, n_nodes, round(metres, 2) AS metres FROM found JOIN sizes USING (component) JOIN metres USING (component) WHERE n_nodes >= 20 AND metres >= 4000"""))
def useful_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the streets that can hold a loop of 8 km."""
    out = search.useful_components(views.streets(spark, sf_dir), least_m=4000.0)
    return out.select("node", "component", "n_nodes", F.round("metres", 2).alias("metres"))


def _snapped(spark: SparkSession, sf_dir: str, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lanes' 2-core, its useful nodes, and the requests on it."""
    lanes = views.lanes(spark, sf_dir)
    core = graph.two_core(lanes.withColumnsRenamed({"u": "src", "v": "dst"})).withColumnsRenamed({"src": "u", "dst": "v"})
    useful = places.settle(search.useful_components(core), "useful")
    return core, useful, places.settle(search.snapped(requests, views.lane_nodes(spark, sf_dir), lanes, useful), "snapped")


_CLOSEST = """SELECT request_id, node_id, d, row_number() OVER (PARTITION BY request_id ORDER BY d, node_id) AS k FROM (SELECT a.request_id, b.node_id, {d} AS d
  FROM outings a JOIN lane_nodes b ON abs(a.lat - b.lat) < 0.014 AND abs(a.lon - b.lon) < 0.021 WHERE b.node_id IN (SELECT node FROM {among})) WHERE d < {most}""".format
#: snaps: where the outings start. A node is gone once fewer than two of its lanes lead to nodes that aren't.
_SNAPS = with_views("nodes", "requests", "streets", "lane_ends", "lanes", "lane_nodes", "outings", sql=f""", sides AS (SELECT edge_id, u AS node, v AS other, length_m FROM lanes UNION ALL SELECT edge_id, v, u, length_m FROM lanes),
gone(node, n) USING KEY (node) AS (SELECT node, 0 FROM sides GROUP BY node HAVING count(*) < 2
  UNION SELECT x.node, 0 FROM gone g JOIN sides y ON y.other = g.node JOIN sides x ON x.node = y.node LEFT JOIN recurring.gone AS r ON r.node = x.other LEFT JOIN recurring.gone AS m ON m.node = x.node
  WHERE m.node IS NULL GROUP BY x.node HAVING count(DISTINCT CASE WHEN r.node IS NULL THEN x.edge_id END) < 2),
core AS (SELECT node, other FROM sides WHERE node NOT IN (SELECT node FROM gone) AND other NOT IN (SELECT node FROM gone)),
grown(node, component) USING KEY (node) AS (SELECT DISTINCT node, node FROM core
  UNION SELECT c.other, min(g.component) FROM grown g JOIN core c ON c.node = g.node JOIN recurring.grown AS r ON r.node = c.other WHERE g.component < r.component GROUP BY c.other),
useful AS (SELECT node, n_nodes FROM (SELECT node, count(*) OVER (PARTITION BY component) AS n_nodes FROM grown) WHERE n_nodes >= {search.LEAST_MESH}),
off AS (SELECT * FROM sides WHERE node NOT IN (SELECT node FROM useful) OR other NOT IN (SELECT node FROM useful)),
reach(node, cost, entry) USING KEY (node) AS (SELECT node, 0::DOUBLE, node FROM useful
  UNION SELECT o.other, min(g.cost + o.length_m), arg_min(g.entry, g.cost + o.length_m) FROM reach g JOIN off o ON o.node = g.node LEFT JOIN recurring.reach AS r ON r.node = o.other WHERE r.cost IS NULL OR g.cost + o.length_m < r.cost GROUP BY o.other),
raws AS ({_CLOSEST(d=views.LENGTH, among='sides', most=search.SNAP_M)}), fits AS ({_CLOSEST(d=views.LENGTH, among='useful', most=search.RESCUE_M)}),
both_ AS (SELECT o.*, r.node_id AS raw, f.node_id AS fit, f.d AS off_m, cost, entry FROM outings o LEFT JOIN raws r ON r.request_id = o.request_id AND r.k = 1 LEFT JOIN fits f ON f.request_id = o.request_id AND f.k = 1 LEFT JOIN reach ON reach.node = r.node_id),
kinds AS (SELECT *, CASE WHEN raw IS NULL THEN 'no path nearby' WHEN cost = 0 THEN 'on' WHEN cost <= km * 1000 * {search.STUB_SHARE}::DOUBLE THEN 'stub' WHEN fit IS NOT NULL THEN 'moved' ELSE 'unreachable' END AS snap FROM both_),
snaps AS (SELECT *, CASE WHEN snap IN ('on', 'stub') THEN entry WHEN snap = 'moved' THEN fit END AS node, CASE WHEN snap = 'stub' THEN cost ELSE 0 END AS stub_m, CASE WHEN snap = 'moved' THEN off_m ELSE 0 END AS moved_m FROM kinds)""")


@query(_SNAPS + " SELECT request_id, snap, node, round(stub_m, 3) AS stub_m, round(moved_m, 3) AS moved_m FROM snaps")
def snapped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each request starts on the lanes' 2-core, and how it gets there."""
    out = _snapped(spark, sf_dir, views.outings(spark, sf_dir))[2]
    return out.select("request_id", "snap", "node", F.round("stub_m", 3).alias("stub_m"), F.round("moved_m", 3).alias("moved_m"))


def _in_areas(spark: SparkSession, sf_dir: str, requests: DataFrame) -> DataFrame:
    return spatial.count_in_areas(choose.work_areas(requests), views.lane_nodes(spark, sf_dir))


@query(_SNAPS + f""", {_AREAS.replace("requests", "outings")}, held AS (SELECT request_id, count(node_id) AS n FROM areas a LEFT JOIN lane_nodes n
  ON n.lat BETWEEN a.lat - {_BOX} AND a.lat + {_BOX} AND n.lon BETWEEN a.lon - {_BOX} / greatest(cos(radians(a.lat)), 0.01) AND a.lon + {_BOX} / greatest(cos(radians(a.lat)), 0.01) GROUP BY request_id)
SELECT request_id, CASE WHEN n < {search.LEAST_NODES} THEN 'too few nodes' WHEN s.node IS NULL THEN snap WHEN n_nodes IS NULL THEN 'mesh too small' ELSE 'ok' END AS status
FROM snaps s JOIN held USING (request_id) LEFT JOIN useful u ON u.node = s.node""")
def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each request can be served, or why not."""
    outings = views.outings(spark, sf_dir)
    _, useful, snaps = _snapped(spark, sf_dir, outings)
    return search.status(snaps, _in_areas(spark, sf_dir, outings), useful)


#: The shapes, rounds and refinements of the registered searches.
LOOPS = {"headings": 2, "corners": (3,), "rounds": 3, "rotations": (-6.0, 6.0), "factors": (0.96, 1.04)}
WAYS = {"counts": (1,), "rounds": 3, "factors": (0.92, 1.08)}
_SHOWN = ("distance_m", "length_m", "repeated_m", "stub_m", "moved_m", "overlap_m", "small_loop_m")


def _shown(rows: DataFrame, *first: str) -> DataFrame:
    edges = F.transform("steps", lambda s: s["edge_id"]).alias("edges")
    return rows.select(*first, "candidate_id", *[F.round(c, 3).alias(c) for c in _SHOWN], "laps", "clean", "raised", "warnings", edges, "line")


@query()
def route_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop of every request over the lanes with its measures, warnings, edges and line, the stub included; or why there is none."""
    outings, nodes, lanes = views.outings(spark, sf_dir), views.lane_nodes(spark, sf_dir), views.lanes(spark, sf_dir)
    core, useful, snaps = _snapped(spark, sf_dir, outings)
    usable = search.restricted(core, useful)
    found = places.settle(search.loops(snaps, nodes, usable, **LOOPS), "loops")
    whole = search.with_stub_lines(found, search.stub_lines(snaps, nodes, lanes))
    states = search.status(snaps, _in_areas(spark, sf_dir, outings), useful, found)
    return states.join(_shown(whole, "request_id"), "request_id", "left")


@query()
def trip_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of every trip from A to B over the lanes with its measures, edges and line, both stubs included; or why there is none."""
    trips, nodes, lanes = views.excursions(spark, sf_dir), views.lane_nodes(spark, sf_dir), views.lanes(spark, sf_dir)
    core, useful, snaps = _snapped(spark, sf_dir, trips.select("request_id", "lat", "lon", "km"))
    usable = search.restricted(core, useful)
    ends = trips.select("request_id", F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon"), "km")
    ends = places.settle(search.snapped(ends, nodes, lanes, useful), "ends")
    named = ends.select("request_id", *[F.col(c).alias(f"end_{c}") for c in ("lat", "lon", "node", "stub_m", "moved_m", "snap")])
    found = places.settle(search.ways_between(snaps.drop("raw").join(named, "request_id"), nodes, usable, **WAYS), "ways")
    whole = search.with_stub_lines(found, search.stub_lines(snaps, nodes, lanes), search.stub_lines(ends, nodes, lanes))
    return _shown(whole, "request_id", "status", F.round("shortest_m", 3).alias("shortest_m"))


#: path: the steps of the cheapest path of each trip. Labels go on from where they fell, below the cost at the target.
_PATHS = with_views("requests", "nodes", "streets", sql=f""", places AS (SELECT request_id, 0 AS place, lat, lon FROM requests
  UNION ALL SELECT request_id, 1, lat + (3 + request_id % 3) * 0.0016::DOUBLE, lon + (2 + request_id % 3) * 0.0016::DOUBLE FROM requests),
near AS (SELECT request_id, place, node_id, row_number() OVER (PARTITION BY request_id, place ORDER BY d, node_id) AS k
  FROM (SELECT request_id, place, node_id, {views.LENGTH} AS d FROM places a JOIN nodes b ON abs(a.lat - b.lat) < 0.014 AND abs(a.lon - b.lon) < 0.021) WHERE d < {search.SNAP_M}),
asks AS (SELECT s.request_id AS query, s.node_id AS source, e.node_id AS target FROM near s JOIN near e ON e.request_id = s.request_id AND s.k = 1 AND e.k = 1 AND s.place = 0 AND e.place = 1 WHERE s.node_id <> e.node_id),
arcs AS (SELECT edge_id, u AS src, v AS dst, length_m, weight FROM streets UNION ALL SELECT edge_id, v, u, length_m, weight FROM streets),
label(query, node, cost) USING KEY (query, node) AS (SELECT query, source, 0::DOUBLE FROM asks
  UNION SELECT l.query, a.dst, min(l.cost + a.weight) FROM label l JOIN asks k ON k.query = l.query JOIN arcs a ON a.src = l.node
  LEFT JOIN recurring.label AS c ON c.query = l.query AND c.node = a.dst LEFT JOIN recurring.label AS t ON t.query = l.query AND t.node = k.target
  WHERE l.cost + a.weight < coalesce(c.cost, 'infinity'::DOUBLE) AND l.cost + a.weight <= coalesce(t.cost, 'infinity'::DOUBLE) GROUP BY l.query, a.dst),
parents AS (SELECT query, node, src, edge_id, length_m FROM (SELECT l.query, l.node, a.src, a.edge_id, a.length_m, row_number() OVER (PARTITION BY l.query, l.node ORDER BY p.cost + a.weight, a.src, a.edge_id) AS k
  FROM label l JOIN asks q ON q.query = l.query AND q.source <> l.node JOIN arcs a ON a.dst = l.node JOIN label p ON p.query = l.query AND p.node = a.src) WHERE k = 1),
back AS (SELECT p.*, 0 AS n FROM parents p JOIN asks q ON q.query = p.query AND q.target = p.node UNION ALL SELECT p.*, n + 1 FROM back b JOIN parents p ON p.query = b.query AND p.node = b.src),
path AS (SELECT query, max(n) OVER (PARTITION BY query) - n AS step, max(n) OVER (PARTITION BY query) AS last, edge_id, src, node AS dst, length_m, l.cost FROM back JOIN asks USING (query) JOIN (SELECT query, node AS target, cost FROM label) l USING (query, target))""")


@query(_PATHS + " SELECT query, step, edge_id, src, dst, round(length_m, 3) AS length_m, round(cost, 3) AS cost FROM path")
def cheapest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the cheapest path of each trip, from the node nearest to its start to the one nearest to its end."""
    return _trip_paths(spark, sf_dir).select("query", "step", "edge_id", "src", "dst", F.round("length_m", 3).alias("length_m"), F.round("cost", 3).alias("cost"))


def _trip_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips, nodes = views.trips(spark, sf_dir), views.nodes(spark, sf_dir)
    end = lambda lat, lon, name: spatial.nearest_dense(trips.select(F.col("request_id").alias("point_id"), F.col(lat).alias("lat"), F.col(lon).alias("lon")), nodes, search.SNAP_M).select(F.col("point_id").alias("request_id"), F.col("node_id").alias(name))
    return trips.join(end("lat", "lon", "node"), "request_id").join(end("end_lat", "end_lon", "end_node"), "request_id").filter("node is not null and end_node is not null")


def _trip_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trip_ends(spark, sf_dir).select(F.col("request_id").alias("query"), F.col("node").alias("source"), F.col("end_node").alias("target"))


def _trip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.cheapest_paths(paths.arcs(views.streets(spark, sf_dir)), _trip_asks(spark, sf_dir))


@query(_PATHS + """ SELECT a.query, source, target, round(l.cost, 3) AS cost, round(l.cost, 3) AS walked FROM asks a LEFT JOIN label l ON l.query = a.query AND l.node = a.target""")
def trip_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each trip costs by the distance labels of the streets, and what the steps of its path add up to."""
    made = labels.labelled(paths.arcs(views.streets(spark, sf_dir)))
    found = places.settle(labels.costs(made, _trip_asks(spark, sf_dir).filter("source <> target")), "costs")
    steps = labels.steps(made, found).join(made.edges.select("src", "dst", "weight"), ["src", "dst"])
    walked = steps.groupBy("query").agg(F.round(F.sum("weight"), 3).alias("walked"))
    return found.join(walked, "query", "left").select("query", "source", "target", F.round("cost", 3).alias("cost"), "walked")


@query(_PATHS + """ SELECT query, step + 1 AS seq, src AS node FROM path UNION ALL SELECT query, last + 2, dst FROM path WHERE step = last
UNION ALL SELECT query, 0, -1 FROM path WHERE step = 0 UNION ALL SELECT query, last + 3, -2 FROM path WHERE step = 0""")
def trip_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that each trip passes in order: from the place it begins at (-1) over its path to the place it ends at (-2)."""
    edges = views.streets(spark, sf_dir).withColumn("polyline", F.array("u", "v"))
    lines = places.settle(paths.polylines(_trip_paths(spark, sf_dir), edges), "lines")
    ends = lines.groupBy("query").agg(F.min_by("node", "seq").alias("a"), F.max_by("node", "seq").alias("b"))
    stub = lambda place, node: ends.select("query", F.posexplode(F.array(F.lit(place).cast("long"), node)).alias("seq", "node"))
    return paths.with_stubs(lines, stub(-1, "a"), stub(-2, "b"))


@query(with_views("path_steps", sql=""", edges AS (SELECT p_partkey AS edge_id, p_retailprice AS metres, p_brand AS label FROM part)
SELECT route_id, label, count(*) AS n, round(sum(metres), 2) AS metres FROM path_steps JOIN edges USING (edge_id) GROUP BY route_id, label"""))
def route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the edges of each route add up to, by label."""
    edges = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge_id"), F.col("p_retailprice").alias("metres"), F.col("p_brand").alias("label"))
    steps = views.path_steps(spark, sf_dir).select("route_id", "edge_id")
    return paths.with_edges(steps, edges).groupBy("route_id", "label").agg(F.count("*").alias("n"), F.round(F.sum("metres"), 2).alias("metres"))


@query(with_views("path_steps", sql=""", sums AS (SELECT route_id, quality, sum(length_m) AS metres FROM path_steps GROUP BY 1, 2)
SELECT route_id, quality, metres, row_number() OVER (PARTITION BY route_id ORDER BY metres DESC, quality) AS rank FROM sums"""))
def route_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The qualities of each route by metres, most first."""
    sums = views.path_steps(spark, sf_dir).groupBy("route_id", "quality").agg(F.sum("length_m").alias("metres"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("route_id").orderBy(F.desc("metres"), "quality")))


@query(with_views("marked", "barriers", sql=""" SELECT (SELECT count(DISTINCT way_id) FROM marked) AS marked_ways, (SELECT count(DISTINCT node_id) FROM barriers
  WHERE coalesce(barrier, '') <> '' AND NOT coalesce(foot IN ('yes', 'designated', 'permissive', 'official'), false)
  AND (coalesce(foot IN ('no', 'private'), false) OR locked IS NOT DISTINCT FROM 'yes' OR coalesce(access IN ('no', 'private', 'customers', 'permit', 'military', 'delivery'), false) OR coalesce(barrier IN ('wall', 'fence', 'hedge'), false))) AS blocked_nodes"""))
def network_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ways are marked and how many nodes are blocked."""
    ways = views.marked(spark, sf_dir).agg(F.count_distinct("way_id").alias("marked_ways"))
    return ways.crossJoin(network.blocked_nodes(views.barriers(spark, sf_dir)).agg(F.count_distinct("node_id").alias("blocked_nodes")))  # one row each


_CUMULATED = """steps AS (SELECT *, coalesce(2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2))), 0) AS d
  FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)), sums AS (SELECT *, sum(d) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum_m FROM steps)"""


@query(with_views("traces", sql=f", {_CUMULATED} SELECT trace_id, min(altitude) AS lowest, max(altitude) AS highest, round(max(cum_m), 3) AS length_m FROM sums GROUP BY trace_id"))
def trace_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest and highest altitude and the length of each trace."""
    from pathloom.operators import traces

    return traces.extremes(views.traces(spark, sf_dir)).select("trace_id", "lowest", "highest", F.round("length_m", 3).alias("length_m"))


@query(with_views("traces", sql=f""", {_CUMULATED}, ends AS (SELECT trace_id, max(cum_m) AS total FROM sums GROUP BY trace_id),
marks AS (SELECT trace_id, unnest(range(0, CAST(floor(total / 500) AS BIGINT) + 1)) AS mark FROM ends)
SELECT trace_id, mark * 500.0::DOUBLE AS mark_m, seq FROM (SELECT trace_id, mark, seq, row_number() OVER (PARTITION BY trace_id, mark ORDER BY round(abs(cum_m - mark * 500), 6), seq) AS k FROM marks JOIN sums USING (trace_id)
  WHERE abs(cum_m - mark * 500) <= 250) WHERE k = 1"""))
def trace_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of each trace nearest to every half kilometre."""
    from pathloom.operators import traces

    return traces.at_marks(views.traces(spark, sf_dir), 500.0).select("trace_id", "mark_m", "seq")


#: The tags that the other views leave out, and their rules in order among the others.
MORE_TAGS = {
    "area": (5, (None, None, None, None, "yes", "no")), "indoor": (53, (None, None, None, None, "yes")), "ford": (59, (None, None, None, "yes", "no", None)),
    "overgrown": (61, (None, None, None, None, None, "yes")), "seasonal": (67, (None, None, "no", None, "winter", None)), "flooded": (71, (None, None, None, None, None, None, "yes")),
    "abandoned": (73, (None, None, None, None, None, "yes")), "obstacle": (79, (None, None, None, "log", None, "step")), "sac_scale": (83, (None, None, "hiking", "mountain_hiking", None)),
}
_MORE = ", ".join(f'{views._sql_tag("way_id", spec)} AS "{k}"' for k, spec in MORE_TAGS.items())


@query(TAGGED + f""", more AS (SELECT way_id, lv, reason, {_MORE} FROM judged)
SELECT way_id, lv AS level, CASE WHEN reason = 'highway' THEN reason WHEN area = 'yes' THEN 'area' WHEN indoor = 'yes' THEN 'indoor' WHEN reason IN ('foot', 'access', 'service', 'danger') THEN reason
  WHEN ford <> 'no' THEN 'ford' WHEN overgrown = 'yes' THEN 'overgrown' WHEN seasonal <> 'no' THEN 'seasonal' WHEN flooded = 'yes' THEN 'flooded' WHEN reason = 'informal' THEN reason
  WHEN abandoned = 'yes' THEN 'abandoned' WHEN obstacle = 'log' THEN 'obstacle' WHEN reason = 'visibility' THEN reason WHEN sac_scale <> 'hiking' THEN 'sac_scale' ELSE reason END AS reason FROM more""")
def all_way_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over ways with all their tags."""
    ways = views.ways(spark, sf_dir).withColumn("tags", F.map_concat("tags", views._tags(F.col("way_id"), MORE_TAGS)))
    return network.judged(ways, views.marked(spark, sf_dir)).select("way_id", "level", "reason")
