"""Registered queries of traces, relief and route candidates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators import choose, corridors, network, relief, traces
from pathloom.sources import files, places, views
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


_HAVERSINE = "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))".format
#: points: traces with cum_m, n, total_m, closed.
_POINTS = with_views("traces", sql=f""", hops AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
lengths AS (SELECT *, sum(coalesce({_HAVERSINE(a='p', b='')}, 0)) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum_m FROM hops),
wholes AS (SELECT trace_id, count(*) AS n, arg_max(cum_m, seq) AS total_m, arg_min(lat, seq) AS alat, arg_min(lon, seq) AS alon, arg_max(lat, seq) AS blat, arg_max(lon, seq) AS blon FROM lengths GROUP BY trace_id),
points AS (SELECT trace_id, seq, lat, lon, altitude, cum_m, n, total_m, {_HAVERSINE(a='a', b='b')} < 25 AS closed FROM lengths JOIN wholes USING (trace_id))""")


@query(_POINTS + " SELECT trace_id, n, round(total_m, 3) AS total_m, closed FROM points WHERE seq = 0")
def trace_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.summary(views.traces(spark, sf_dir)).withColumn("total_m", F.round("total_m", 3))


_WIDE = "111320 * cos(radians(a.mlat))"
_SEGMENT = f"""sqrt(pow((b.lon - a.mlon) * {_WIDE} + k * (b.lon2 - b.lon) * {_WIDE}, 2) + pow((b.lat - a.mlat) * 111320 + k * (b.lat2 - b.lat) * 111320, 2))"""


@query(_POINTS + f""", steps AS (SELECT trace_id, seq AS s, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, cum_m, lead(cum_m) OVER w AS cum2, total_m, closed, n FROM points WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
mids AS (SELECT *, (lat + lat2) / 2 AS mlat, (lon + lon2) / 2 AS mlon FROM steps WHERE lat2 IS NOT NULL AND n >= 4),
cells AS (SELECT *, floor(mlat * 111320 / 40) AS r, floor(mlon * 111320 * cos(radians(mlat)) / 40) AS c FROM mids),
pairs AS (SELECT a.trace_id, a.s, a.mlat, a.mlon, b.lat, b.lon, b.lat2, b.lon2,
  CASE WHEN (b.lon2 - b.lon) = 0 AND (b.lat2 - b.lat) = 0 THEN 0 ELSE greatest(0, least(1, -(((b.lon - a.mlon) * {_WIDE}) * ((b.lon2 - b.lon) * {_WIDE}) + ((b.lat - a.mlat) * 111320) * ((b.lat2 - b.lat) * 111320))
     / (pow((b.lon2 - b.lon) * {_WIDE}, 2) + pow((b.lat2 - b.lat) * 111320, 2)))) END AS k
  FROM cells a JOIN cells b ON a.trace_id = b.trace_id AND a.s <> b.s AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1
  WHERE CASE WHEN a.closed THEN least(abs(a.cum_m - b.cum_m), a.total_m - abs(a.cum_m - b.cum_m)) ELSE abs(a.cum_m - b.cum_m) END >= 80),
hits AS (SELECT DISTINCT trace_id, s FROM (SELECT trace_id, s, {_SEGMENT.replace('a.', '').replace('b.', '')} AS d FROM pairs) WHERE d < 15),
runs AS (SELECT m.trace_id, m.cum_m, m.cum2, m.s - row_number() OVER (PARTITION BY m.trace_id ORDER BY m.s) AS run FROM mids m JOIN hits h ON h.trace_id = m.trace_id AND h.s = m.s),
portions AS (SELECT trace_id, max(cum2) - min(cum_m) AS m FROM runs GROUP BY trace_id, run HAVING max(cum2) - min(cum_m) >= 25),
sums AS (SELECT trace_id, sum(m) AS m, count(*) AS n FROM portions GROUP BY trace_id)
SELECT t.trace_id, round(coalesce(m, 0), 2) AS overlap_m, coalesce(n, 0) AS n_portions FROM (SELECT DISTINCT trace_id FROM points) t LEFT JOIN sums USING (trace_id)""")
def trace_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.overlap(views.traces(spark, sf_dir)).withColumn("overlap_m", F.round("overlap_m", 2))


@query(_POINTS + f""", cells AS (SELECT *, floor(lat * 111320 / 80) AS r, floor(lon * 111320 * cos(radians(lat)) / 80) AS c FROM points WHERE n >= 4 AND total_m * 0.25::DOUBLE > 80),
spans AS (SELECT a.trace_id, a.seq AS i, max(b.seq) AS j, min(a.cum_m) AS f, max(b.cum_m) AS t FROM cells a JOIN cells b ON a.trace_id = b.trace_id AND b.seq > a.seq AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1
  WHERE b.cum_m - a.cum_m BETWEEN 80 AND a.total_m * 0.25::DOUBLE AND {_HAVERSINE(a='a.', b='b.')} < 80 AND b.cum_m - a.cum_m >= 4 * {_HAVERSINE(a='a.', b='b.')} GROUP BY a.trace_id, a.seq),
marks AS (SELECT *, i > coalesce(max(j) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM spans),
islands AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY trace_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM marks),
loops AS (SELECT trace_id, max(t) - min(f) AS m FROM islands GROUP BY trace_id, k)
SELECT t.trace_id, round(coalesce(sum(m), 0), 2) AS small_loop_m, count(m) AS n_small_loops FROM (SELECT DISTINCT trace_id FROM points) t LEFT JOIN loops USING (trace_id) GROUP BY t.trace_id""")
def trace_small_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.small_loops(views.traces(spark, sf_dir)).withColumn("small_loop_m", F.round("small_loop_m", 2))


@query(_POINTS + """, steps AS (SELECT trace_id, seq, lat, lon, lead(lat) OVER w - lat AS dy, lead(lon) OVER w - lon AS dx FROM points WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
heads AS (SELECT trace_id, seq, degrees(atan2(dx * cos(radians(lat)), dy)) AS h FROM steps WHERE abs(dy) >= 9e-5::DOUBLE OR abs(dx) >= 1.4e-4::DOUBLE),
turns AS (SELECT trace_id, h - lag(h) OVER (PARTITION BY trace_id ORDER BY seq) AS d FROM heads),
sharp AS (SELECT trace_id, count(*) FILTER (abs(d - 360 * floor((d + 180) / 360)) > 100) AS n_turns FROM turns GROUP BY trace_id)
SELECT p.trace_id, CASE WHEN n < 3 THEN 0 ELSE coalesce(n_turns, 0) END AS n_turns,
       round(CASE WHEN total_m > 0 THEN CASE WHEN n < 3 THEN 0 ELSE coalesce(n_turns, 0) END / (total_m / 1000) ELSE 0 END, 4) AS per_km
FROM points p LEFT JOIN sharp USING (trace_id) WHERE seq = 0""")
def trace_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.sharp_turns(views.traces(spark, sf_dir)).withColumn("per_km", F.round("per_km", 4))


@query(with_views("traces", sql=""", marks AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
steps AS (SELECT *, CAST(ceil(n / 20.0) AS BIGINT) AS step FROM marks),
lasts AS (SELECT trace_id, arg_max(lat, i) AS llat, arg_max(lon, i) AS llon FROM steps WHERE n <= 20 OR i % step = 0 GROUP BY trace_id)
SELECT trace_id, seq, round(s.lat, 7) AS lat, round(s.lon, 7) AS lon FROM steps s JOIN lasts USING (trace_id)
WHERE n <= 20 OR i % step = 0 OR (i = n - 1 AND (lat <> llat OR lon <> llon))"""))
def trace_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traces.thinned(views.traces(spark, sf_dir).drop("altitude"), 20)
    return out.select("trace_id", "seq", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(with_views("traces", sql=""", fold AS (SELECT trace_id, seq, altitude AS ref, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM traces WHERE seq = 0
UNION ALL SELECT t.trace_id, t.seq, CASE WHEN t.altitude > ref + 3 OR t.altitude < ref - 3 THEN t.altitude ELSE ref END,
  up + CASE WHEN t.altitude > ref + 3 THEN t.altitude - ref ELSE 0 END, down + CASE WHEN t.altitude < ref - 3 THEN ref - t.altitude ELSE 0 END
  FROM fold f JOIN traces t ON t.trace_id = f.trace_id AND t.seq = f.seq + 1),
ends AS (SELECT trace_id, arg_max(up, seq) AS gain_m, arg_max(down, seq) AS loss_m FROM fold GROUP BY trace_id),
span AS (SELECT trace_id, min(altitude) AS lowest_m, max(altitude) AS highest_m FROM traces GROUP BY trace_id HAVING count(*) = count(altitude))
SELECT trace_id, round(gain_m, 3) AS gain_m, round(loss_m, 3) AS loss_m, lowest_m, highest_m FROM ends JOIN span USING (trace_id)""").replace("WITH traces", "WITH RECURSIVE traces"))
def trace_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relief.climbs(views.traces(spark, sf_dir))
    return out.withColumns({c: F.round(c, 3) for c in ("gain_m", "loss_m")})


@query(with_views("traces", sql="""SELECT trace_id, seq, round(CASE WHEN count(*) OVER (PARTITION BY trace_id) < 3 THEN altitude
  ELSE avg(altitude) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END, 6) AS smooth FROM traces"""))
def trace_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relief.smoothed(views.traces(spark, sf_dir)).select("trace_id", "seq", F.round("smooth", 6).alias("smooth"))


@query(with_views("traces", sql=""", steps AS (SELECT trace_id, seq, (lead(altitude) OVER w - altitude) / 25 * 100 AS slope FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
kinds AS (SELECT *, CASE WHEN slope <= -8 THEN 'steep_down' WHEN slope <= -3 THEN 'down' WHEN slope <= 3 THEN 'flat' WHEN slope <= 8 THEN 'up' ELSE 'steep_up' END AS class FROM steps WHERE slope IS NOT NULL),
news AS (SELECT *, lag(class) OVER (PARTITION BY trace_id ORDER BY seq) IS DISTINCT FROM class AS fresh FROM kinds)
SELECT trace_id, class, CAST(count(*) * 25 AS DOUBLE) AS metres, count(*) FILTER (fresh) AS n_runs FROM news GROUP BY trace_id, class"""))
def trace_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relief.slope_classes(views.traces(spark, sf_dir).withColumn("distance_m", F.col("seq") * relief.STEP_M))


_SCORED = with_views("candidates", sql=""", errors AS (SELECT *, (length_m - target_m) / target_m AS off FROM candidates),
weighed AS (SELECT *, CASE WHEN off >= 0 THEN off ELSE least(-off, 0.005::DOUBLE) * 10::DOUBLE + greatest(0::DOUBLE, -off - 0.005::DOUBLE) * 3::DOUBLE END AS error, repeated_m / length_m AS share FROM errors),
scored AS (SELECT *, CASE WHEN error <= 0.05::DOUBLE THEN 0 ELSE 1 END AS tier, CASE WHEN error <= 0.05::DOUBLE THEN round_even(share * 200, 0) ELSE error END AS s1, CASE WHEN error <= 0.05::DOUBLE THEN round_even(error * 200, 0) ELSE share END AS s2 FROM weighed)""")


@query(_SCORED + " SELECT request_id, candidate_id, tier, round(s1, 9) AS s1, round(s2, 9) AS s2, turns FROM scored")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = choose.scored(views.candidates(spark, sf_dir))
    return out.select("request_id", "candidate_id", "score.tier", F.round("score.first", 9).alias("s1"), F.round("score.second", 9).alias("s2"), "turns")


@query(_SCORED + """ SELECT request_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, s1, s2, turns, candidate_id) AS rank
FROM scored WHERE repeated_m / length_m <= 0.12::DOUBLE) WHERE rank <= 3""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose.best(views.candidates(spark, sf_dir), n=3).select("request_id", "candidate_id", "rank")


@query(with_views("path_steps", sql=""", kinds AS (SELECT route_id, 'highway' AS kind, highway AS label, length_m FROM path_steps UNION ALL SELECT route_id, 'quality', quality, length_m FROM path_steps),
sums AS (SELECT route_id, kind, label, sum(length_m) AS metres FROM kinds GROUP BY ALL)
SELECT route_id, kind, label, metres, round(metres / sum(metres) OVER (PARTITION BY route_id, kind), 6) AS share FROM sums"""))
def route_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.breakdowns(views.path_steps(spark, sf_dir), ["route_id"]).withColumn("share", F.round("share", 6))


@query(with_views("path_steps", sql=""", sums AS (SELECT route_id, corridor_id, sum(length_m) AS a, max(length_m) AS t FROM path_steps GROUP BY ALL)
SELECT route_id, sum(a) AS length_m, sum(greatest(0, a - t)) AS repeated_m FROM sums GROUP BY route_id"""))
def route_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose.repeated_metres(views.path_steps(spark, sf_dir))


@query(with_views("requests", sql="SELECT request_id, round(least(25000::DOUBLE, 0.40::DOUBLE * km * 1000 + 800), 3) AS radius_m FROM requests"))
def request_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose.work_areas(views.requests(spark, sf_dir)).select("request_id", F.round("radius_m", 3).alias("radius_m"))


_MARKS = """, hops AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
lengths AS (SELECT *, coalesce(sqrt(pow((lat - plat) * 111320::DOUBLE, 2) + pow((lon - plon) * 111320::DOUBLE * cos(radians(plat)), 2)), 0) AS hop FROM hops),
sums AS (SELECT *, sum(hop) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c1 FROM lengths),
marks AS (SELECT *, CAST(floor((c1 - hop) / 25 + 1e-12) AS BIGINT) + 1 AS a, CAST(floor(c1 / 25) AS BIGINT) AS b FROM sums),
inner_ AS (SELECT trace_id, k, k * 25::DOUBLE AS d, plat + (lat - plat) * (k * 25 - (c1 - hop)) / hop AS lat, plon + (lon - plon) * (k * 25 - (c1 - hop)) / hop AS lon
  FROM (SELECT *, unnest(range(a, b + 1)) AS k FROM marks WHERE hop > 0)),
ends AS (SELECT trace_id, max(c1) AS total, arg_min(lat, seq) AS alat, arg_min(lon, seq) AS alon, arg_max(lat, seq) AS blat, arg_max(lon, seq) AS blon FROM sums GROUP BY trace_id)"""


@query(with_views("traces", sql=_MARKS + """
SELECT trace_id, k, round(d, 3) AS distance_m, round(lat, 7) AS lat, round(lon, 7) AS lon FROM inner_
UNION ALL SELECT trace_id, 0, 0, round(alat, 7), round(alon, 7) FROM ends
UNION ALL SELECT trace_id, CAST(floor(total / 25) AS BIGINT) + 1, round(total, 3), round(blat, 7), round(blon, 7) FROM ends WHERE total - floor(total / 25) * 25 > 12.5"""))
def trace_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relief.resampled(views.traces(spark, sf_dir))
    return out.select("trace_id", "k", F.round("distance_m", 3).alias("distance_m"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


#: samples: every 25 m of the traces that stay on the terrain, with altitude, smooth and slope_pct.
_PROFILES = with_views("traces", "terrain", sql=_MARKS + f""", marked AS (SELECT trace_id, k, d, lat, lon FROM inner_ UNION ALL SELECT trace_id, 0, 0, alat, alon FROM ends
  UNION ALL SELECT trace_id, CAST(floor(total / 25) AS BIGINT) + 1, total, blat, blon FROM ends WHERE total - floor(total / 25) * 25 > 12.5),
placed AS (SELECT *, (lon + 180) / 360 * {256 << views.ZOOM} - 0.5 AS wx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {256 << views.ZOOM} - 0.5 AS wy FROM marked),
corners AS (SELECT trace_id, k, CAST(floor(wx) AS BIGINT) + i AS x, CAST(floor(wy) AS BIGINT) + j AS y, abs(1 - i - (wx - floor(wx))) * abs(1 - j - (wy - floor(wy))) AS w FROM placed, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
heights AS (SELECT trace_id, k, CASE WHEN count(altitude) = 4 THEN sum(w * altitude) END AS altitude FROM corners LEFT JOIN terrain USING (x, y) GROUP BY trace_id, k),
known AS (SELECT trace_id, max(k) AS n FROM heights GROUP BY trace_id HAVING count(*) >= 2 AND count(altitude) = count(*)),
raised AS (SELECT trace_id, k, d, lat, lon, altitude, n FROM marked JOIN heights USING (trace_id, k) JOIN known USING (trace_id)),
smoothed AS (SELECT *, CASE WHEN n < 2 THEN altitude ELSE avg(altitude) OVER (PARTITION BY trace_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS smooth, (d + lead(d) OVER (PARTITION BY trace_id ORDER BY k)) / 2 AS mid FROM raised),
spans AS (SELECT m.trace_id, m.k, coalesce(max(x.k) FILTER (x.d <= m.mid - 75), 0) AS a, coalesce(min(x.k) FILTER (x.d >= m.mid + 75), any_value(m.n)) AS b
  FROM smoothed m JOIN smoothed x USING (trace_id) WHERE m.mid IS NOT NULL GROUP BY m.trace_id, m.k),
slopes AS (SELECT p.trace_id, p.k, (y.smooth - x.smooth) / (y.d - x.d) * 100 AS slope_pct FROM spans p JOIN smoothed x ON x.trace_id = p.trace_id AND x.k = p.a JOIN smoothed y ON y.trace_id = p.trace_id AND y.k = p.b),
samples AS (SELECT * FROM smoothed LEFT JOIN slopes USING (trace_id, k))""")


@query(_PROFILES + """ SELECT trace_id, k, round(d, 3) AS distance_m, round(altitude, 4) AS altitude, round(smooth, 4) AS smooth, round(slope_pct, 4) AS slope_pct,
CASE WHEN slope_pct <= -8 THEN 'steep_down' WHEN slope_pct <= -3 THEN 'down' WHEN slope_pct <= 3 THEN 'flat' WHEN slope_pct <= 8 THEN 'up' WHEN slope_pct IS NOT NULL THEN 'steep_up' END AS class FROM samples""")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain every 25 m along the traces: altitude, smoothed altitude, slope over 150 m and its class."""
    samples, _ = relief.profile(views.traces(spark, sf_dir), views.terrain(spark, sf_dir), views.ZOOM)
    rounded = [F.round(c, d).alias(c) for c, d in (("distance_m", 3), ("altitude", 4), ("smooth", 4), ("slope_pct", 4))]
    return samples.select("trace_id", "k", *rounded, geo.slope_class(F.col("slope_pct")).alias("class"))


@query(_PROFILES + """, fold AS (SELECT trace_id, k, altitude AS ref, 0::DOUBLE AS up, 0::DOUBLE AS down FROM raised WHERE k = 0
UNION ALL SELECT t.trace_id, t.k, CASE WHEN abs(t.altitude - ref) > 3 THEN t.altitude ELSE ref END, up + CASE WHEN t.altitude > ref + 3 THEN t.altitude - ref ELSE 0 END, down + CASE WHEN t.altitude < ref - 3 THEN ref - t.altitude ELSE 0 END
  FROM fold f JOIN raised t ON t.trace_id = f.trace_id AND t.k = f.k + 1),
climbs AS (SELECT trace_id, arg_max(up, k) AS gain_m, arg_max(down, k) AS loss_m FROM fold GROUP BY trace_id),
spread AS (SELECT trace_id, count(*) AS n_samples, max(d) AS length_m, min(altitude) AS lowest_m, max(altitude) AS highest_m FROM raised GROUP BY trace_id)
SELECT trace_id, n_samples, round(length_m, 3) AS length_m, round(gain_m, 3) AS gain_m, round(loss_m, 3) AS loss_m, round(lowest_m, 3) AS lowest_m, round(highest_m, 3) AS highest_m FROM spread JOIN climbs USING (trace_id)""")
def trace_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, length, gain, loss and extremes of every trace that stays on the terrain."""
    _, sums = relief.profile(views.traces(spark, sf_dir), views.terrain(spark, sf_dir), views.ZOOM)
    return sums.select("trace_id", "n_samples", *[F.round(c, 3).alias(c) for c in ("length_m", "gain_m", "loss_m", "lowest_m", "highest_m")])



@query(with_views("traces", sql=""", s AS (SELECT trace_id, seq, altitude, seq * 25::DOUBLE AS d, max(seq) OVER (PARTITION BY trace_id) AS n FROM traces),
mids AS (SELECT *, d + 12.5 AS mid FROM s WHERE seq < n),
spans AS (SELECT m.trace_id, m.seq, coalesce(max(x.seq) FILTER (x.seq <= m.seq AND x.d <= m.mid - 75), 0) AS a, coalesce(min(x.seq) FILTER (x.seq > m.seq AND x.d >= m.mid + 75), any_value(m.n)) AS b
  FROM mids m JOIN s x USING (trace_id) GROUP BY m.trace_id, m.seq)
SELECT p.trace_id, p.seq, round((y.altitude - x.altitude) / (y.d - x.d) * 100, 6) AS slope_pct FROM spans p JOIN s x ON x.trace_id = p.trace_id AND x.seq = p.a JOIN s y ON y.trace_id = p.trace_id AND y.seq = p.b"""))
def trace_span_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relief.span_slopes(views.traces(spark, sf_dir).withColumn("distance_m", F.col("seq") * relief.STEP_M))
    return out.withColumn("slope_pct", F.round("slope_pct", 6))


@query(with_views("traces", sql="""SELECT trace_id, '{"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [' || string_agg(printf('[%.6f, %.6f]', lon, lat), ', ' ORDER BY seq) || ']}}' AS geojson FROM traces GROUP BY trace_id"""))
def trace_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.geojson(views.traces(spark, sf_dir))


@query(with_views("traces", sql=f"""SELECT trace_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="pathloom" xmlns="http://www.topografix.com/GPX/1/1">' || chr(10) || '  <metadata>' || chr(10)
 || '    <name>Trace &lt;' || trace_id || '&gt;</name>' || chr(10) || '    <copyright author="OpenStreetMap contributors">' || chr(10) || '      <license>{files.LICENCE}</license>' || chr(10) || '    </copyright>' || chr(10) || '  </metadata>' || chr(10)
 || '  <trk>' || chr(10) || '    <name>Trace &lt;' || trace_id || '&gt;</name>' || chr(10) || '    <trkseg>' || chr(10) || string_agg(printf('      <trkpt lat="%.6f" lon="%.6f"></trkpt>', lat, lon), chr(10) ORDER BY seq)
 || chr(10) || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' || chr(10) AS gpx FROM traces GROUP BY trace_id"""))
def trace_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.gpx(views.traces(spark, sf_dir), F.concat(F.lit("Trace <"), F.col("trace_id").cast("string"), F.lit(">")))


_DRAWN = _SCORED.replace("FROM candidates)", "FROM (SELECT *, CAST(candidate_id % 90 AS DOUBLE) AS overlap_m, CAST(candidate_id % 110 AS DOUBLE) AS small_loop_m FROM candidates))", 1)


@query(_DRAWN + """, ranked AS (SELECT *, row_number() OVER w AS first FROM scored WINDOW w AS (PARTITION BY request_id ORDER BY tier, s1, s2, turns, candidate_id)),
fit AS (SELECT r.* FROM ranked r JOIN (SELECT request_id, greatest(error, 0.05::DOUBLE) AS bound FROM ranked WHERE first = 1) b USING (request_id) WHERE first = 1 OR error <= bound),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY first) AS rank, overlap_m <= greatest(30, target_m * 0.005::DOUBLE) AND small_loop_m <= 60 AS clean FROM fit)
SELECT request_id, candidate_id, rank, clean FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY NOT clean, CASE WHEN clean THEN 0 ELSE overlap_m + small_loop_m END, rank) AS k FROM placed WHERE rank <= 120) WHERE k = 1""")
def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = views.candidates(spark, sf_dir).withColumns({"overlap_m": (F.col("candidate_id") % 90).cast("double"), "small_loop_m": (F.col("candidate_id") % 110).cast("double")})
    return choose.clean_choice(drawn)


@query(_SCORED + """, under AS (SELECT request_id, candidate_id AS usual, error + share AS ucost, tier FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, s1, s2, turns, candidate_id) AS k FROM scored WHERE share <= 0.12::DOUBLE) WHERE k = 1),
over_ AS (SELECT request_id, candidate_id AS other, cost FROM (SELECT *, error + share AS cost, row_number() OVER (PARTITION BY request_id ORDER BY error + share, candidate_id) AS k FROM scored WHERE share > 0.12::DOUBLE AND share <= 0.25::DOUBLE) WHERE k = 1),
both_ AS (SELECT *, coalesce(tier = 1, true) AND other IS NOT NULL AND coalesce(cost < ucost, true) AS raised FROM under FULL JOIN over_ USING (request_id))
SELECT request_id, CASE WHEN raised THEN other ELSE usual END AS candidate_id, raised FROM both_ WHERE CASE WHEN raised THEN other ELSE usual END IS NOT NULL""")
def rescued_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose.rescued(views.candidates(spark, sf_dir))


@query(with_views("requests", sql="""SELECT request_id, strftime(ts, '%Y-%m-%d_%Hh%M') || '_' || printf('%.1f', km) || 'km' || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.gpx' AS file,
'Loop ' || printf('%.1f', km) || ' km' || CASE WHEN laps > 1 THEN ' x' || laps ELSE '' END || ' of ' || strftime(ts, '%d/%m/%Y') AS title
FROM (SELECT *, row_number() OVER (PARTITION BY ts, km ORDER BY request_id) - 1 AS n FROM (SELECT request_id, km, TIMESTAMP '2026-01-01 06:00:00' + INTERVAL (request_id % 30) MINUTE AS ts, 1 + request_id % 3 AS laps FROM requests))"""))
def request_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.timestamp_seconds(F.lit(1767247200) + F.col("request_id") % 30 * 60)
    rows = views.requests(spark, sf_dir).select("request_id", "km", when.alias("ts"), (1 + F.col("request_id") % 3).alias("laps"))
    named = files.file_names(rows, "km", "ts")
    return named.select("request_id", "file", files.display_name(F.col("km"), F.col("laps"), F.col("ts")).alias("title"))


_LINES = _POINTS + f""", pts AS (SELECT trace_id * 100000 + seq // 8 AS edge_id, seq % 8 AS pos, lat + (trace_id % 1000) * 0.002::DOUBLE AS lat, lon FROM points),
steps AS (SELECT edge_id, pos, lat AS alat, lon AS alon, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon FROM pts WINDOW w AS (PARTITION BY edge_id ORDER BY pos)),
long AS (SELECT edge_id, sum({_HAVERSINE(a='a', b='b')}) AS len FROM steps WHERE blat IS NOT NULL GROUP BY edge_id HAVING sum({_HAVERSINE(a='a', b='b')}) >= 25),
cells AS (SELECT DISTINCT edge_id, len, floor(lat * 111320 / 30) + i AS r, floor(lon * 111320 * cos(radians(lat)) / 30) + j AS c
  FROM pts JOIN long USING (edge_id), (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)),
maybe AS (SELECT DISTINCT p.edge_id AS a, q.edge_id AS b FROM cells p JOIN cells q ON p.r = q.r AND p.c = q.c AND p.edge_id < q.edge_id WHERE p.len <= q.len * 2.2::DOUBLE AND q.len <= p.len * 2.2::DOUBLE),
ways AS (SELECT a AS e, b AS f FROM maybe UNION ALL SELECT b, a FROM maybe),
far AS (SELECT w.e, w.f, p.pos, (s.alon - p.lon) * 111320 * cos(radians(p.lat)) AS ax, (s.alat - p.lat) * 111320 AS ay, (s.blon - s.alon) * 111320 * cos(radians(p.lat)) AS dx, (s.blat - s.alat) * 111320 AS dy
  FROM ways w JOIN pts p ON p.edge_id = w.e JOIN steps s ON s.edge_id = w.f AND s.blat IS NOT NULL),
near AS (SELECT e, f, pos, min(sqrt(pow(ax + k * dx, 2) + pow(ay + k * dy, 2))) AS d FROM (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS k FROM far) GROUP BY ALL),
shares AS (SELECT e, f, count(*) FILTER (d < 14) / count(*) AS s FROM near GROUP BY e, f),
twins AS (SELECT m.a, m.b FROM maybe m JOIN shares x ON x.e = m.a AND x.f = m.b JOIN shares y ON y.e = m.b AND y.f = m.a WHERE x.s >= 0.65::DOUBLE AND y.s >= 0.65::DOUBLE)"""


#: Pieces of a trace that the ids of the SQL have room for.
_PIECES = 100000


def _lines(points: DataFrame) -> DataFrame:
    """edge_id (the trace and the number of the piece), line and length_m of the pieces of 8 points."""
    points = points.filter("trace_id is not null").withColumn("edge_id", F.struct("trace_id", F.floor(F.col("seq") / 8).alias("piece"))).withColumn("lat", F.col("lat") + F.col("trace_id") % 1000 * 0.002)
    lines = points.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("l")).select("edge_id", F.transform("l", lambda x: F.struct(x["lat"], x["lon"])).alias("line"))
    lines = lines.withColumn("line", F.col("line").cast("array<struct<lat:double,lon:double>>"))
    hop = lambda i: geo.great_circle(F.get("line", i)["lat"], F.get("line", i)["lon"], F.get("line", i + 1)["lat"], F.get("line", i + 1)["lon"])
    hops = F.when(F.size("line") >= 2, F.transform(F.sequence(F.lit(0), F.size("line") - 2), hop)).otherwise(F.array().cast("array<double>"))
    return lines.withColumn("length_m", F.aggregate(hops, F.lit(0.0), lambda a, x: a + x))


@query(_LINES + " SELECT a, b FROM twins")
def twin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corridors.twins(_numbered(_lines(views.traces(spark, sf_dir))))


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` by the ids of the SQL. Pieces from _PIECES on, where those run into the next trace, have ids of their own
    from the least long on: 30 bits of the trace and 32 of the piece; what doesn't fit is an error."""
    wide = lambda e: F.raise_error(F.concat(F.lit("no id for piece "), e["piece"].cast("string"), F.lit(" of trace "), e["trace_id"].cast("string"))).cast("long")
    fits = lambda e: e["trace_id"].between(0, (1 << 30) - 1) & (e["piece"] < 1 << 32)
    far = lambda e: F.when(fits(e), F.lit(-(1 << 63)) + e["trace_id"].cast("long") * (1 << 32) + e["piece"]).otherwise(wide(e))
    name = lambda e: F.when(e["piece"] < _PIECES, e["trace_id"] * _PIECES + e["piece"]).otherwise(far(e))
    return lines.withColumn("edge_id", name(F.col("edge_id")))


_CORRIDORS = _LINES + """, links AS (SELECT a, b FROM twins UNION SELECT b, a FROM twins),
grown(edge_id, corridor_id) USING KEY (edge_id) AS (SELECT DISTINCT a, a FROM links
  UNION SELECT l.b, min(g.corridor_id) FROM grown g JOIN links l ON l.a = g.edge_id JOIN recurring.grown AS c ON c.edge_id = l.b WHERE g.corridor_id < c.corridor_id GROUP BY l.b),
ends AS (SELECT edge_id, list({'lat': lat, 'lon': lon} ORDER BY pos) AS l FROM pts GROUP BY edge_id),
named AS (SELECT e.edge_id, coalesce(g.corridor_id, e.edge_id) AS corridor_id, l FROM ends e LEFT JOIN grown g USING (edge_id))"""


@query(_CORRIDORS + """, vectors AS (SELECT n.edge_id, n.corridor_id, n.edge_id = n.corridor_id AS own,
  (b.l[-1].lon - b.l[1].lon) * cos(radians(b.l[1].lat)) * 111320 AS rx, (b.l[-1].lat - b.l[1].lat) * 111320 AS ry,
  (n.l[-1].lon - n.l[1].lon) * cos(radians(n.l[1].lat)) * 111320 AS ix, (n.l[-1].lat - n.l[1].lat) * 111320 AS iy,
  (n.l[1 + len(n.l) // 2].lon - b.l[1].lon) * cos(radians(b.l[1].lat)) * 111320 AS ox, (n.l[1 + len(n.l) // 2].lat - b.l[1].lat) * 111320 AS oy
  FROM named n JOIN ends b ON b.edge_id = n.corridor_id)
SELECT edge_id, corridor_id, round(CASE WHEN own OR sqrt(rx * rx + ry * ry) < 1 THEN 0 ELSE (rx * oy - ry * ox) / sqrt(rx * rx + ry * ry) END, 6) + 0.0::DOUBLE AS offset_m,
  CASE WHEN own OR sqrt(rx * rx + ry * ry) < 1 OR ix * rx + iy * ry >= 0 THEN 1 ELSE -1 END AS alignment FROM vectors""")
def edge_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corridor of every piece, how far left of its first edge it runs, and whether it runs the same way."""
    out = corridors.corridors(places.settle(_numbered(_lines(views.traces(spark, sf_dir))), "lines"))
    return out.select("edge_id", "corridor_id", (F.round("offset_m", 6) + 0.0).alias("offset_m"), "alignment")


@query(_CORRIDORS + """ SELECT (SELECT count(*) FROM twins) AS n_pairs, (SELECT count(*) FROM (SELECT corridor_id FROM named GROUP BY corridor_id HAVING count(*) > 1)) AS n_corridors""")
def corridor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of twins there are, and how many corridors they form."""
    lines = places.settle(_numbered(_lines(views.traces(spark, sf_dir))), "lines")
    pairs = places.settle(corridors.twins(lines), "twins")
    return corridors.counts(corridors.corridors(lines, pairs), pairs)
