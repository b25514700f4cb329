"""Traces of any length: points are worked on in blocks of consecutive points, never a whole trace in one task.

``indexed`` numbers the points of each trace over ranges of rows. BLOCK consecutive points are a block; a block has what
it needs of its neighbours as a halo of points, a carried sum or a carried state, which are drawn from one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.sources import places

BLOCK = 1 << 16
#: Traces with more points than this are worked on in blocks where a whole trace would be one task's.
LONG = 1 << 20


def indexed(rows: DataFrame, block: int | None = None, by: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``rows`` (trace_id, seq and others) with i, the place of the row in its trace from 0 in the order of ``by``, and block; rows without a trace are left out."""
    order = ["trace_id", *by]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = places.settle(ranged.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "points")
    counts = marked.groupBy("trace_id", "_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    before = Window.partitionBy("trace_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = counts.select("trace_id", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = marked.join(base, ["trace_id", "_part"]).withColumn("i", F.col("_before") + F.col("_nth") - F.col("_first"))
    return placed.drop("_part", "_nth", "_first", "_before").withColumn("block", F.floor(F.col("i") / (block or BLOCK)))


def with_halo(points: DataFrame, before: int, after: int, block: int | None = None) -> DataFrame:
    """``points`` (with i and block) and, marked by halo, up to so many points before and after each block, in its group."""
    size = block or BLOCK
    at = F.col("i") % size
    ahead, behind = F.when(at >= size - before, 1), F.when(at < after, -1)
    moved = F.explode(F.array_compact(F.array(F.lit(0), ahead, behind)))
    each = points.withColumn("_s", moved).filter("block + _s >= 0")
    return each.withColumns({"halo": F.col("_s") != 0, "block": F.col("block") + F.col("_s")}).drop("_s")


def by_block() -> Window:
    return Window.partitionBy("trace_id", "block").orderBy("i")


def long_ones(traces: DataFrame) -> DataFrame | None:
    """trace_id of the traces with more than LONG points, fewer than the points over LONG; None if there are none."""
    found = traces.groupBy("trace_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > LONG).select("trace_id")
    settled = places.settle(found, "long")
    return None if settled.isEmpty() else settled


def split(traces: DataFrame, usual, blocked) -> DataFrame:
    """``usual(traces)``, but ``blocked`` for the long ones among them; both give the same rows."""
    long_ = long_ones(traces)
    if long_ is None:
        return usual(traces)
    of = F.broadcast(long_)  # each has more than LONG points
    return usual(traces.join(of, "trace_id", "left_anti")).unionByName(blocked(traces.join(of, "trace_id", "left_semi")))


def measured(traces: DataFrame, closed_m: float, block: int | None = None) -> DataFrame:
    """``traces.measured`` by blocks: cum_m, n, total_m, closed."""
    haloed = with_halo(indexed(traces, block), 1, 0, block)
    back = [F.lag(c).over(by_block()) for c in ("lat", "lon")]
    hops = haloed.withColumn("_d", F.coalesce(geo.great_circle(back[0], back[1], F.col("lat"), F.col("lon")), F.lit(0.0))).filter("not halo")
    inner = hops.withColumn("_c", F.sum("_d").over(by_block().rowsBetween(Window.unboundedPreceding, 0)))
    inner = places.settle(inner.drop("_d", "halo"), "hops")
    place = F.struct("lat", "lon")
    sums = inner.groupBy("trace_id", "block").agg(F.max("_c").alias("_m"), F.count("*").alias("_n"), F.min_by(place, "i").alias("_a"), F.max_by(place, "i").alias("_b"))
    order = Window.partitionBy("trace_id").orderBy("block")  # a row per block
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b = F.first("_a").over(whole), F.last("_b").over(whole)
    gap = geo.great_circle(a["lat"], a["lon"], b["lat"], b["lon"])
    carried = sums.select("trace_id", "block", F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.sum("_n").over(whole).alias("n"), F.sum("_m").over(whole).alias("total_m"), (gap < closed_m).alias("closed"))
    out = inner.join(carried, ["trace_id", "block"]).withColumn("cum_m", F.col("_before") + F.col("_c"))
    return out.select(*traces.columns, "cum_m", "n", "total_m", "closed")


def climbs(samples: DataFrame, fold, block: int | None = None) -> DataFrame:
    """``relief.climbs`` by blocks; ``fold(values, reference)`` is its fold over an array from a reference on.

    A block's gain depends on the reference that it is entered with, which is the one that the block before it is left
    with. All blocks are folded at once from what is known, and again those whose reference turned out another: after
    its first change a block no longer depends on it, so two or three rounds settle all but flat stretches.
    """
    points = indexed(samples.select("trace_id", "seq", "altitude"), block)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "altitude"))), lambda x: x["altitude"])
    arrays = points.groupBy("trace_id", "block").agg(ordered.alias("a"), F.bool_or(F.col("altitude").isNull()).alias("_gap"), F.min("altitude").alias("lowest_m"), F.max("altitude").alias("highest_m"))
    tables = places.Rounds(samples.sparkSession, "climbs")
    arrays = tables.settle(arrays, "arrays")
    gaps = arrays.filter("_gap").select("trace_id").distinct()
    kept = arrays.join(gaps, "trace_id", "left_anti")
    folded = lambda df: df.withColumn("_f", fold(F.col("a"), F.col("ref"))).select("trace_id", "block", "ref", F.col("_f.ref").alias("left"), "_f.gain_m", "_f.loss_m")
    state = tables.settle(folded(kept.withColumn("ref", F.get("a", F.lit(0)))), "state")
    order = Window.partitionBy("trace_id").orderBy("block")  # a row per block
    while True:
        entered = state.withColumn("enter", F.coalesce(F.lag("left").over(order), F.col("ref")))
        wrong = tables.settle(entered.filter("enter <> ref").select("trace_id", "block", F.col("enter").alias("ref")), "wrong")
        if wrong.isEmpty():
            break
        again = folded(kept.join(wrong, ["trace_id", "block"]))
        right = state.join(wrong.select("trace_id", "block"), ["trace_id", "block"], "left_anti")
        state = tables.replace(right.unionByName(again), "state")
    sums = state.groupBy("trace_id").agg(F.sum("gain_m").alias("gain_m"), F.sum("loss_m").alias("loss_m"))
    ends = kept.groupBy("trace_id").agg(F.min("lowest_m").alias("lowest_m"), F.max("highest_m").alias("highest_m"))
    return sums.join(ends, "trace_id")


def smoothed(samples: DataFrame, half: int, block: int | None = None) -> DataFrame:
    """``relief.smoothed`` by blocks."""
    points = indexed(samples, block)
    sizes = points.groupBy("trace_id").agg(F.count("*").alias("_n"))
    mean = F.avg("altitude").over(by_block().rowsBetween(-half, half))
    out = with_halo(points, half, half, block).withColumn("_mean", mean).filter("not halo").join(sizes, "trace_id")
    return out.withColumn("smooth", F.when(F.col("_n") < 3, F.col("altitude")).otherwise(F.col("_mean"))).select(*samples.columns, "smooth")


def hops(traces: DataFrame, length, block: int | None = None) -> DataFrame:
    """``relief.hops`` by blocks; ``length`` is the metres between two places."""
    back = [F.lag(c).over(by_block()) for c in ("lat", "lon")]
    hop = F.coalesce(length(back[0], back[1], F.col("lat"), F.col("lon")), F.lit(0.0))
    haloed = with_halo(indexed(traces.select("trace_id", "seq", "lat", "lon"), block), 1, 0, block)
    each = haloed.withColumns({"plat": back[0], "plon": back[1], "hop": hop}).filter("not halo")
    inner = each.withColumn("_c", F.sum("hop").over(by_block().rowsBetween(Window.unboundedPreceding, 0)))
    inner = places.settle(inner.drop("halo"), "hops")
    earlier = Window.partitionBy("trace_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sums = inner.groupBy("trace_id", "block").agg(F.max("_c").alias("_m"))
    carried = sums.select("trace_id", "block", F.coalesce(F.sum("_m").over(earlier), F.lit(0.0)).alias("_before"))
    before = F.coalesce(F.lag("_c").over(by_block()), F.lit(0.0))
    out = inner.withColumn("_l", before).join(carried, ["trace_id", "block"])
    return out.select("trace_id", "seq", "lat", "lon", "plat", "plon", "hop", (F.col("_before") + F.col("_c")).alias("c1"), F.when(F.col("i") > 0, F.col("_before") + F.col("_l")).alias("c0"))


def span_ends(samples: DataFrame, span_m: float, block: int | None = None) -> DataFrame:
    """trace_id, seq, a, b of every step: the last sample up to half of ``span_m`` before its middle and the first from
    half of it after, the trace's first and last where there is none.

    Samples and the two questions of each step are put in one order of distance; a question reads the sample next to it,
    inside its block or else from the row of a block before or after. So however many samples lie within the span, no
    task has more than its blocks.
    """
    points = indexed(samples.select("trace_id", "seq", "distance_m", "altitude"), block)
    steps = with_halo(points, 0, 1, block).withColumn("_d2", F.lead("distance_m").over(by_block())).filter("not halo and _d2 is not null")
    middle = (F.col("distance_m") + F.col("_d2")) / 2
    asked = lambda kind, shift: steps.select("trace_id", "seq", (middle + shift).alias("_at"), F.lit(kind).alias("_kind"))
    given = points.select("trace_id", "seq", F.col("distance_m").alias("_at"), F.lit(1).alias("_kind"), F.struct("distance_m", "altitude").alias("_p"))
    both = given.unionByName(asked(0, span_m / 2), allowMissingColumns=True).unionByName(asked(2, -span_m / 2), allowMissingColumns=True)
    placed = indexed(both, block, ("_at", "_kind", "seq"))
    is_point = F.when(F.col("_p").isNotNull(), F.col("i"))
    ends = placed.groupBy("trace_id", "block").agg(F.min_by("_p", is_point).alias("_first"), F.max_by("_p", is_point).alias("_last"))
    order = Window.partitionBy("trace_id").orderBy("block")  # a row per block
    back, whole = Window.partitionBy("trace_id").orderBy(F.desc("block")), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda c, window: F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(
        "trace_id", "block", F.coalesce(near("_last", order), F.first("_first", ignorenulls=True).over(whole)).alias("_before"),
        F.coalesce(near("_first", back), F.last("_last", ignorenulls=True).over(whole)).alias("_after"),
    )
    inside = lambda window: F.last("_p", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    reverse = Window.partitionBy("trace_id", "block").orderBy(F.desc("i"))
    met = placed.withColumns({"_a": inside(by_block()), "_b": inside(reverse)}).filter("_kind <> 1").join(carried, ["trace_id", "block"])
    a, b = F.when(F.col("_kind") == 2, F.coalesce("_a", "_before")), F.when(F.col("_kind") == 0, F.coalesce("_b", "_after"))
    return met.groupBy("trace_id", "seq").agg(F.max(a).alias("a"), F.max(b).alias("b"))


def headings(steps: DataFrame) -> DataFrame:
    """``steps`` (block, i and heading) with previous, the heading of the step before in the trace."""
    inside = steps.withColumn("_h", F.lag("heading").over(by_block()))
    lasts = steps.groupBy("trace_id", "block").agg(F.max_by("heading", "i").alias("_last"))
    carried = lasts.select("trace_id", "block", F.lag("_last").over(Window.partitionBy("trace_id").orderBy("block")).alias("_before"))  # a row per block
    return inside.join(carried, ["trace_id", "block"]).withColumn("previous", F.coalesce("_h", "_before")).drop("_h", "_before")


def thinned(traces: DataFrame, most: int, block: int | None = None) -> DataFrame:
    """``traces.thinned`` by blocks."""
    points = indexed(traces, block)
    sizes = points.groupBy("trace_id").agg(F.count("*").alias("_n")).withColumn("_step", F.ceil(F.col("_n") / most))
    marked = points.join(sizes, "trace_id")
    last_kept = F.floor((F.col("_n") - 1) / F.col("_step")) * F.col("_step")
    lasts = marked.filter(F.col("i") == last_kept).select("trace_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    moved = (F.col("lat") != F.col("_lat")) | (F.col("lon") != F.col("_lon"))
    keep = (F.col("_n") <= most) | (F.col("i") % F.col("_step") == 0) | ((F.col("i") == F.col("_n") - 1) & moved)
    return marked.join(lasts, "trace_id").filter(keep).select(*traces.columns)


def pieces(traces: DataFrame, line: Column, head: Column, tail: str, between: str, block: int | None = None) -> DataFrame:
    """trace_id, piece, text: a document per trace as rows to be written one after another: ``head`` (a column over
    trace_id), the ``line`` of every point with ``between`` them, ``tail``. No row holds more than a block of points."""
    points = indexed(traces, block).withColumn("_l", line)
    texts = points.groupBy("trace_id", "block").agg(F.array_sort(F.collect_list(F.struct("i", "_l"))).alias("_p"))
    last = texts.groupBy("trace_id").agg(F.max("block").alias("_last"))
    body = F.array_join(F.transform("_p", lambda x: x["_l"]), between)
    whole = F.concat(F.when(F.col("block") == 0, head).otherwise(F.lit(between)), body, F.when(F.col("block") == F.col("_last"), tail).otherwise(""))
    return texts.join(last, "trace_id").select("trace_id", F.col("block").alias("piece"), whole.alias("text"))
