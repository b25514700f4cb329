"""From ways to a runnable network: valid ways, segments, cuts at barriers, degrees, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.functions.rules import DEFAULT, LEVELS, Judge, Rules, impassable, prepared, unprepared

#: Rows up to which a side is broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_nodes(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ways`` with the arrays nodes and geometry (struct of lat and lon) from rows (way_id, pos, node_id).

    A node without a position leaves a place in nodes and none in geometry, so the way isn't valid.
    """
    placed = way_nodes.join(nodes, "node_id", "left")
    point = F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))
    arrays = placed.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", point.alias("point")))).alias("_l"))
    known = F.filter("_l", lambda x: x["point"].isNotNull())
    arrays = arrays.select("way_id", F.transform("_l", lambda x: x["node_id"]).alias("nodes"), F.transform(known, lambda x: x["point"]).alias("geometry"))
    return ways.join(arrays, "way_id")


def valid(ways: DataFrame) -> DataFrame:
    """Ways with as many points as nodes, two or more."""
    return ways.filter((F.size("nodes") == F.size("geometry")) & (F.size("nodes") >= 2))


def judged(ways: DataFrame, marked: DataFrame | None = None, levels: tuple[str, ...] = LEVELS, rules: Rules = DEFAULT) -> DataFrame:
    """A row per way and level: the columns of ``ways``, level, marked, reason (of a refusal) and verdict.

    All levels are judged in one pass over the ways. No ``marked`` table means that no way is marked.
    """
    if marked is None:
        flagged = ways.withColumn("marked", F.lit(False))
    else:
        ids = marked.select("way_id").distinct().withColumn("_m", F.lit(True))
        flagged = ways.join(small(ids), "way_id", "left").withColumn("marked", F.coalesce("_m", F.lit(False))).drop("_m")
    each = prepared(flagged, rules).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    judge = Judge(rules)
    return unprepared(each.withColumn("reason", judge.refusal()).withColumn("verdict", judge.verdict("reason")))


def blocked_nodes(barriers: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    return barriers.filter(impassable(F.col("tags"), rules)).select("node_id").distinct()


def segments(ways: DataFrame) -> DataFrame:
    """A row per step of a way: its other columns, pos, src, dst and length_m. Inside the row, without a shuffle.

    Steps on the spot (same node, or no length) are dropped.
    """
    step = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(i.alias("pos"), F.get("nodes", i).alias("src"), F.get("nodes", i + 1).alias("dst"), F.get("geometry", i).alias("a"), F.get("geometry", i + 1).alias("b")))
    each = valid(ways).withColumn("_s", F.explode(step)).drop("nodes", "geometry")
    length = geo.great_circle(F.col("_s.a.lat"), F.col("_s.a.lon"), F.col("_s.b.lat"), F.col("_s.b.lon"))
    out = each.select("*", "_s.pos", "_s.src", "_s.dst", length.alias("length_m")).drop("_s")
    return out.filter("src <> dst and length_m > 0")


def cut(steps: DataFrame, blocked: DataFrame) -> DataFrame:
    """Steps that touch no blocked node at either end."""
    ids = small(blocked.select("node_id"))
    return steps.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti")


def passable(ways: DataFrame, marked: DataFrame | None = None, barriers: DataFrame | None = None, levels: tuple[str, ...] = LEVELS, rules: Rules = DEFAULT) -> DataFrame:
    """The steps of all ways that can be run on: way_id, level, pos, src, dst, length_m, cost, highway, quality."""
    kept = judged(valid(ways), marked, levels, rules).filter("verdict is not null").select("way_id", "level", "nodes", "geometry", "verdict.*")
    steps = segments(kept)
    return steps if barriers is None else cut(steps, blocked_nodes(barriers, rules))


def half_edges(steps: DataFrame) -> DataFrame:
    """Every step in both directions."""
    return steps.unionByName(steps.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def degrees(steps: DataFrame) -> DataFrame:
    """node and degree; parallel steps count each, a loop twice."""
    return steps.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def breakdowns(steps: DataFrame, by: list[str], labels: tuple[str, ...] = ("highway", "quality"), length: str = "length_m") -> DataFrame:
    """Metres and share by each of ``labels``, in one pass: by, kind (which label), label, metres, share."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in labels]))
    each = steps.select(*by, F.col(length).alias("_m"), kinds.alias("_k")).select(*by, "_m", "_k.*")
    sums = each.groupBy(*by, "kind", "label").agg(F.sum("_m").alias("metres"))
    total = sums.groupBy(*by, "kind").agg(F.sum("metres").alias("_t"))
    return sums.join(total, [*by, "kind"]).select(*by, "kind", "label", "metres", F.when(F.col("_t") > 0, F.col("metres") / F.col("_t")).alias("share"))


def audit(ways: DataFrame, marked: DataFrame | None = None, rules: Rules = DEFAULT) -> DataFrame:
    """How many ways each level keeps or refuses by reason, with the totals: level, reason, n (reason null: kept)."""
    out = judged(ways, marked, rules=rules).select("level", F.coalesce("reason", F.lit("kept")).alias("reason"))
    counted = out.rollup("level", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("depth"))
    return counted.filter("level is not null").select("level", F.when(F.col("depth") == 0, F.col("reason")).otherwise("all").alias("reason"), "n")
