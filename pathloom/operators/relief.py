"""Elevation of traces (trace_id, seq, altitude, distance_m): gain and loss, smoothing, slopes, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators import blocks
from pathloom.operators.network import small
from pathloom.sources import places

THRESHOLD_M, WINDOW, SPAN_M, STEP_M = 3.0, 7, 150.0, 25.0


def _climb(values: Column, threshold: float, reference: Column | None = None) -> Column:
    """Gain and loss over an ordered array: a change counts once it exceeds the threshold from the reference (at first the
    ``reference``, or else the first value)."""
    start = F.struct((F.get(values, F.lit(0)) if reference is None else reference).alias("ref"), F.lit(0.0).alias("gain_m"), F.lit(0.0).alias("loss_m"))

    def step(acc: Column, x: Column) -> Column:
        up, down = x > acc["ref"] + threshold, x < acc["ref"] - threshold
        return F.struct(
            F.when(up | down, x).otherwise(acc["ref"]).alias("ref"),
            (acc["gain_m"] + F.when(up, x - acc["ref"]).otherwise(0.0)).alias("gain_m"),
            (acc["loss_m"] + F.when(down, acc["ref"] - x).otherwise(0.0)).alias("loss_m"),
        )

    return F.aggregate(values, start, step)


def climbs(samples: DataFrame, threshold: float = THRESHOLD_M) -> DataFrame:
    """trace_id, gain_m, loss_m, lowest_m, highest_m; a trace with a missing altitude is dropped whole."""
    return blocks.split(samples, lambda usual: _climbs(usual, threshold), lambda long_: blocks.climbs(long_, lambda a, r: _climb(a, threshold, r)))


def _climbs(samples: DataFrame, threshold: float) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "altitude"))), lambda x: x["altitude"])
    grouped = samples.groupBy("trace_id").agg(ordered.alias("_a"), F.bool_or(F.col("altitude").isNull()).alias("_gap"), F.min("altitude").alias("lowest_m"), F.max("altitude").alias("highest_m"))
    whole = grouped.filter("not _gap").withColumn("_c", _climb(F.col("_a"), threshold))
    return whole.select("trace_id", "_c.gain_m", "_c.loss_m", "lowest_m", "highest_m")


def smoothed(samples: DataFrame, window: int = WINDOW) -> DataFrame:
    """``samples`` with smooth: the mean over a window that shrinks at the ends; as it is below 3 samples."""
    return blocks.split(samples, lambda usual: _smoothed(usual, window // 2), lambda long_: blocks.smoothed(long_, window // 2))


def _smoothed(samples: DataFrame, half: int) -> DataFrame:
    trace = Window.partitionBy("trace_id")
    mean = F.avg("altitude").over(trace.orderBy("seq").rowsBetween(-half, half))
    return samples.withColumn("smooth", F.when(F.count("*").over(trace) < 3, F.col("altitude")).otherwise(mean))


def slope_classes(samples: DataFrame) -> DataFrame:
    """trace_id, class, metres, n_runs: metres and stretches of each class, by the slope of single steps.

    ``samples`` has distance_m, the metres from the start.
    """
    columns = ("trace_id", "class", "run", "new")
    usual = lambda df: _class_steps(df, Window.partitionBy("trace_id").orderBy("seq")).select(*columns)
    blocked = lambda df: _class_steps(blocks.with_halo(blocks.indexed(df), 1, 1), blocks.by_block()).filter("not halo").select(*columns)
    return blocks.split(samples, usual, blocked).groupBy("trace_id", "class").agg(F.sum("run").alias("metres"), F.sum("new").alias("n_runs"))


def _class_steps(samples: DataFrame, order: Window) -> DataFrame:
    """The steps with run, class and new, 1 where the class differs from that of the step before."""
    run, rise = F.lead("distance_m").over(order) - F.col("distance_m"), F.lead("altitude").over(order) - F.col("altitude")
    steps = samples.withColumns({"run": run, "rise": rise}).filter("run is not null")
    steps = steps.withColumn("class", geo.slope_class(F.when(F.col("run") > 0, F.col("rise") / F.col("run") * 100).otherwise(0.0)))
    return steps.withColumn("new", F.coalesce(F.lag("class").over(order) != F.col("class"), F.lit(True)).cast("int"))


def hops(traces: DataFrame) -> DataFrame:
    """trace_id, seq, lat, lon, plat, plon, hop, c1, c0: the place before each point, the metres from there on the local
    plane, and those from the start to the point and to the one before (null at the first)."""
    return blocks.split(traces, _hops, lambda long_: blocks.hops(long_, geo.planar))


def _hops(traces: DataFrame) -> DataFrame:
    order = Window.partitionBy("trace_id").orderBy("seq")
    back = [F.lag(c).over(order) for c in ("lat", "lon")]
    hop = F.coalesce(geo.planar(back[0], back[1], F.col("lat"), F.col("lon")), F.lit(0.0))
    points = traces.select("trace_id", "seq", "lat", "lon", back[0].alias("plat"), back[1].alias("plon"), hop.alias("hop"))
    points = points.withColumn("c1", F.sum("hop").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return points.withColumn("c0", F.lag("c1").over(order))


def resampled(traces: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """trace_id, k, distance_m, lat, lon: a point every ``step_m`` along the trace, on the local plane.

    Each segment yields the marks that fall in it, so nothing is joined. The last place is added if it lies more
    than half a step after the last mark; a trace of one point is that point.
    """
    points = hops(traces)
    first = F.floor(F.col("c0") / step_m) + 1
    points = points.withColumns({"first": first, "last": F.floor(F.col("c1") / step_m)})
    marks = points.filter((F.col("hop") > 0) & (F.col("last") >= F.col("first"))).withColumn("k", F.explode(F.sequence("first", "last")))
    share = (F.col("k") * step_m - (F.col("c1") - F.col("hop"))) / F.col("hop")
    between = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * share
    inner = marks.select("trace_id", "k", (F.col("k") * step_m).alias("distance_m"), between("plat", "lat").alias("lat"), between("plon", "lon").alias("lon"))
    ends = points.groupBy("trace_id").agg(*[f(c, "seq").alias(f"{k}_{c}") for c in ("lat", "lon") for k, f in (("a", F.min_by), ("b", F.max_by))], F.max("c1").alias("total"))
    start = ends.select("trace_id", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("distance_m"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"))
    full = F.floor(F.col("total") / step_m)
    tail = ends.filter(F.col("total") - full * step_m > step_m / 2).select("trace_id", (full + 1).alias("k"), F.col("total").alias("distance_m"), F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon"))
    return start.unionByName(inner).unionByName(tail)


def interpolated(points: DataFrame, pixels: DataFrame, zoom: int) -> DataFrame:
    """``points`` (with point_id) and altitude: bilinear between the four pixels around, null if one is missing.

    ``pixels`` has x, y (pixel of the whole world at ``zoom``) and altitude. Squares of four pixels are put together
    where points lie, and a point finds its own by one equi-join.
    """
    x, y = geo.world_pixel(F.col("lat"), F.col("lon"), zoom)
    placed = points.withColumns({"_wx": x - 0.5, "_wy": y - 0.5}).withColumns({"_x": F.floor("_wx"), "_y": F.floor("_wy")})
    corners = F.explode(F.array(*[F.struct((F.col("_x") + i).alias("x"), (F.col("_y") + j).alias("y"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)]))
    # points that lie between the same four pixels ask for them once
    asked = placed.select("_x", "_y").distinct().select("_x", "_y", corners.alias("c")).select("_x", "_y", "c.*")
    asked = small(places.settle(asked, "pixels"))
    met = pixels.select("x", "y", "altitude").join(asked, ["x", "y"]).groupBy("_x", "_y")
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("altitude")))
    squares = met.agg(F.count("altitude").alias("_n"), *[of(k).alias(f"_a{k}") for k in range(4)]).filter("_n = 4").drop("_n")
    squares = small(places.settle(squares, "squares"))
    fx, fy = F.col("_wx") - F.col("_x"), F.col("_wy") - F.col("_y")
    altitude = sum((fx if i else 1 - fx) * (fy if j else 1 - fy) * F.col(f"_a{2 * i + j}") for i in (0, 1) for j in (0, 1))
    return placed.join(squares, ["_x", "_y"], "left").select(*points.columns, altitude.alias("altitude"))


def profile(traces: DataFrame, pixels: DataFrame, zoom: int, step_m: float = STEP_M, window: int = WINDOW, threshold: float = THRESHOLD_M, span_m: float = SPAN_M) -> tuple[DataFrame, DataFrame]:
    """The samples (trace_id, k, distance_m, lat, lon, altitude, smooth, slope_pct) of traces over the terrain ``pixels``,
    and a row per trace: trace_id, n_samples, length_m, gain_m, loss_m, lowest_m, highest_m.

    Gain and extremes are those of the terrain, slopes those of the smoothed altitudes; the slope of a sample is that of
    the step after it, null at the last. A trace that leaves the pixels, or has fewer than two samples, has no profile.
    """
    marks = places.settle(resampled(traces, step_m), "marks")
    raised = interpolated(marks, pixels, zoom)
    raised = places.settle(raised.withColumn("seq", F.col("k")), "samples")
    whole = raised.groupBy("trace_id").agg((F.count("*") >= 2).alias("_two"), (F.count("altitude") == F.count("*")).alias("_known")).filter("_two and _known").select("trace_id")
    samples = raised.join(whole, "trace_id")
    smooth = smoothed(samples, window)
    slopes = span_slopes(smooth.select("trace_id", "seq", "distance_m", F.col("smooth").alias("altitude")), span_m).withColumnRenamed("seq", "k")
    ends = samples.groupBy("trace_id").agg(F.count("*").alias("n_samples"), F.max("distance_m").alias("length_m"))
    return smooth.drop("seq").join(slopes, ["trace_id", "k"], "left"), ends.join(climbs(samples, threshold), "trace_id")


def span_slopes(samples: DataFrame, span_m: float = SPAN_M) -> DataFrame:
    """trace_id, seq, slope_pct of each step, measured over about ``span_m`` (above 0) around its middle.

    The window's ends depend on the distances, so the arrays of a usual trace are searched with numpy; a long one's ends
    are found in blocks. Null where an altitude at an end is missing.
    """
    if span_m <= 0:
        raise ValueError("span_m must be above 0")
    return blocks.split(samples, lambda usual: _span_slopes(usual, span_m), lambda long_: _blocked_slopes(long_, span_m))


def _blocked_slopes(samples: DataFrame, span_m: float, block: int | None = None) -> DataFrame:
    run, rise = F.col("b.distance_m") - F.col("a.distance_m"), F.col("b.altitude") - F.col("a.altitude")
    return blocks.span_ends(samples, span_m, block).select("trace_id", "seq", F.when(run > 0, rise / run * 100).otherwise(0.0).alias("slope_pct"))


def _span_slopes(samples: DataFrame, span_m: float) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def slopes(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        d, a = table["distance_m"].to_numpy(), table["altitude"].to_numpy()
        middle = (d[:-1] + d[1:]) / 2
        before = np.minimum(np.maximum(np.searchsorted(d, middle - span_m / 2, "right") - 1, 0), np.arange(len(middle)))
        after = np.maximum(np.minimum(np.searchsorted(d, middle + span_m / 2, "left"), len(d) - 1), np.arange(len(middle)) + 1)
        run = d[after] - d[before]
        slope = np.where(run > 0, (a[after] - a[before]) / np.where(run > 0, run, 1) * 100, 0.0)
        return pa.table({"trace_id": table["trace_id"][:-1], "seq": table["seq"][:-1], "slope_pct": pa.array(slope, from_pandas=True)})

    kind = samples.schema["trace_id"].dataType.simpleString()
    seq = samples.schema["seq"].dataType.simpleString()
    return samples.select("trace_id", "seq", "distance_m", "altitude").groupBy("trace_id").applyInArrow(slopes, f"trace_id {kind}, seq {seq}, slope_pct double")
