"""Twin ways: edges that run side by side (a street and its sidewalks) form one corridor.

``edges`` has edge_id, length_m and line (array of lat and lon). Two edges are twins if both lie within GAP_M of
each other over most of their length. Pairs are only looked for among edges whose boxes meet in a cell of the grid, and
only edges of similar length are compared; the comparison happens where the pair is found, over batches of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators.graph import components
from pathloom.operators.network import small
from pathloom.sources import places

GAP_M, COVERAGE, LEAST_M, RATIO, SAMPLES = 14.0, 0.65, 25.0, 2.2, 16
#: Side of the smallest cells; longer edges have cells of twice that and so on.
CELL_M = 200.0
#: Edges of a cell that one task pairs; more are dealt out. Distances that are held at once.
CROWD, MOST_DISTANCES = 4096, 1 << 20


def _box(line: Column) -> Column:
    """The box of a line, and the same box wider by GAP_M on each side."""
    lat, lon = F.transform(line, lambda p: p["lat"]), F.transform(line, lambda p: p["lon"])
    south, north, west, east = F.array_min(lat), F.array_max(lat), F.array_min(lon), F.array_max(lon)
    high = GAP_M / geo.METRES_PER_DEGREE
    wide = high / F.greatest(F.cos(F.radians(F.greatest(F.abs(south), F.abs(north)))), F.lit(1e-6))
    return F.struct(south.alias("s"), north.alias("n"), west.alias("w"), east.alias("e"), (south - high).alias("s2"), (north + high).alias("n2"), (west - wide).alias("w2"), (east + wide).alias("e2"))


def _level(length: Column) -> Column:
    """The level of the cells that are at least as large as an edge of that length."""
    return F.greatest(F.lit(0), F.ceil(F.log2(length / CELL_M))).cast("int")


def _row(lat: Column, level: Column) -> Column:
    return F.floor(lat / (CELL_M / geo.METRES_PER_DEGREE * F.pow(F.lit(2.0), level)))


def _column(lon: Column, row: Column, level: Column) -> Column:
    """Columns are as wide as rows are high, by the latitude at which the row begins."""
    side = CELL_M / geo.METRES_PER_DEGREE * F.pow(F.lit(2.0), level)
    return F.floor(lon / side * F.greatest(F.cos(F.radians(row * side)), F.lit(0.01)))


def _cells(south: Column, north: Column, west: Column, east: Column, level: Column) -> Column:
    """The cells (row, col) that a box touches."""
    in_row = lambda r: F.transform(F.sequence(_column(west, r, level), _column(east, r, level)), lambda c: F.struct(r.alias("row"), c.alias("col")))
    return F.flatten(F.transform(F.sequence(_row(south, level), _row(north, level)), in_row))


def twins(edges: DataFrame) -> DataFrame:
    """a, b: the pairs of twins, a < b.

    An edge lies in the cells of its length's level that its box, wider by GAP_M, touches, and is held against the edges of
    similar length that touch them, shorter ones at that level too. Two boxes meet in one cell that is theirs, the one that
    has the south-western corner of what they share, so a pair is found once, with both lines at hand.
    """
    drawn = edges.filter((F.col("length_m") >= LEAST_M) & (F.size("line") >= 2)).select(
        "edge_id", "length_m", _level(F.col("length_m")).alias("own"), _box(F.col("line")).alias("x"), F.transform(F.col("line"), lambda p: p["lat"]).alias("lat"), F.transform(F.col("line"), lambda p: p["lon"]).alias("lon")
    )
    tables = places.Rounds(edges.sparkSession, "twins")
    drawn = tables.settle(drawn, "drawn")
    key, level = ["level", "row", "col"], F.col("level")
    one = drawn.withColumn("level", F.col("own")).withColumn("cell", F.explode(_cells(F.col("x.s2"), F.col("x.n2"), F.col("x.w2"), F.col("x.e2"), level)))
    one = one.select(F.col("edge_id").alias("p"), F.col("length_m").alias("lp"), *[F.col(f"x.{c}2").alias(f"p{c}") for c in "snwe"], F.col("lat").alias("plat"), F.col("lon").alias("plon"), "level", "cell.*")
    two = drawn.withColumn("level", F.explode(F.sequence("own", _level(F.col("length_m") * RATIO)))).withColumn("cell", F.explode(_cells(F.col("x.s"), F.col("x.n"), F.col("x.w"), F.col("x.e"), level)))
    two = two.select(F.col("edge_id").alias("q"), F.col("length_m").alias("lq"), F.col("own").alias("oq"), *[F.col(f"x.{c}").alias(f"q{c}") for c in "snwe"], F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), "level", "cell.*")
    # the edges of a crowded cell are dealt to several tasks, each of which has all edges of the other side
    crowds = two.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(*key, F.ceil(F.col("n") / CROWD).alias("parts"))
    crowds = small(tables.settle(crowds, "crowds"))
    parts = F.coalesce("parts", F.lit(1))
    one = one.join(crowds, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    two = two.join(crowds, key, "left").withColumn("part", F.pmod(F.xxhash64("q"), parts)).drop("parts")
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are many more than rows
    dealt = lambda df: df.repartition(tasks, *key, "part")
    alike = (F.col("lp") <= F.col("lq") * RATIO) & (F.col("lq") <= F.col("lp") * RATIO)
    close = (F.col("ps") <= F.col("qn")) & (F.col("qs") <= F.col("pn")) & (F.col("pw") <= F.col("qe")) & (F.col("qw") <= F.col("pe"))
    once = (F.col("oq") < level) | (F.col("p") < F.col("q"))
    theirs = (F.col("row") == _row(F.greatest("ps", "qs"), level)) & (F.col("col") == _column(F.greatest("pw", "qw"), F.col("row"), level))
    pairs = dealt(one).join(dealt(two), [*key, "part"]).filter(once & alike & close & theirs)
    pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "plat", "plon", "qlat", "qlon")
    kind = edges.schema["edge_id"].dataType.simpleString()
    return pairs.mapInArrow(_covered, f"a {kind}, b {kind}")


def _covered(batches: Iterator) -> Iterator:
    """The pairs (a, b) of which each line covers enough of the other."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        sizes = [batch[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("plat", "qlat")]
        flat = [batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("plat", "plon", "qlat", "qlon")]
        first = [np.concatenate(([0], np.cumsum(n)))[:-1] for n in sizes]
        kept = np.zeros(batch.num_rows, dtype=bool)
        longest = np.maximum(*sizes)
        order, at = np.argsort(longest, kind="stable"), 0
        while at < len(order):  # pairs of lines of similar size, as many as memory allows
            most = longest[order[min(len(order), at + 4096) - 1]]
            taken = order[at : at + max(1, min(4096, MOST_DISTANCES // int(min(most, 2 * SAMPLES) * most)))]
            most = longest[taken].max()
            lines = [_padded(flat[2 * k], flat[2 * k + 1], first[k][taken], sizes[k][taken], most) for k in (0, 1)]
            near = _share(*lines[0], *lines[1][:2]) >= COVERAGE
            if near.any():
                some = np.flatnonzero(near)
                near[some] = _share(*[x[some] for x in lines[1]], *[x[some] for x in lines[0][:2]]) >= COVERAGE
            kept[taken] = near
            at += len(taken)
        yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(kept)) for c in ("a", "b")], names=["a", "b"])


def _padded(lat, lon, first, sizes, most: int) -> tuple:
    """Lines as rows of ``most`` places, nan after their end, and which of the places are samples: at most about SAMPLES
    evenly chosen ones, and the last."""
    import numpy as np

    k = np.arange(most)
    inside = k < sizes[:, None]
    at = np.where(inside, first[:, None] + k, 0)
    lat, lon = np.where(inside, lat[at], np.nan), np.where(inside, lon[at], np.nan)
    step = np.maximum(1, -(-sizes // SAMPLES))
    sample = inside & (k % step[:, None] == 0)
    row, last = np.arange(len(sizes)), sizes - 1
    chosen = last // step * step
    sample[row, last] |= (lat[row, chosen] != lat[row, last]) | (lon[row, chosen] != lon[row, last])
    return lat, lon, sample


def _share(lat, lon, sample, lat2, lon2):
    """Share of the samples of each line that lie within GAP_M of the other line of its row."""
    import numpy as np

    most = int(sample.sum(1).max())
    order = np.argsort(~sample, axis=1, kind="stable")[:, :most]  # samples first
    sample, lat, lon = (np.take_along_axis(x, order, 1) for x in (sample, lat, lon))
    width = (geo.METRES_PER_DEGREE * np.cos(np.radians(lat)))[:, :, None]
    lat, lon = lat[:, :, None], lon[:, :, None]
    ax, ay = (lon2[:, None, :-1] - lon) * width, (lat2[:, None, :-1] - lat) * geo.METRES_PER_DEGREE
    dx, dy = np.diff(lon2)[:, None, :] * width, np.diff(lat2)[:, None, :] * geo.METRES_PER_DEGREE
    square = dx * dx + dy * dy
    with np.errstate(invalid="ignore", divide="ignore"):
        along = np.where(square > 0, np.clip(-(ax * dx + ay * dy) / square, 0.0, 1.0), 0.0)
        near = (np.hypot(ax + along * dx, ay + along * dy) < GAP_M).any(2)
    return (near & sample).sum(1) / sample.sum(1)


def counts(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: n_pairs of twins and n_corridors of two edges or more."""
    several = found.groupBy("corridor_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n_corridors"))
    return pairs.agg(F.count("*").alias("n_pairs")).crossJoin(several)  # one row each


def corridors(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """edge_id, corridor_id (its smallest edge), offset_m (from that edge, left is positive), alignment (1 or -1).

    ``pairs`` are the twins of the edges, where they are known already.
    """
    found = components(twins(edges) if pairs is None else pairs).select(F.col("node").alias("edge_id"), F.col("component").alias("corridor_id"))
    lines = edges.select("edge_id", "line").join(found, "edge_id", "left").withColumn("corridor_id", F.coalesce("corridor_id", "edge_id"))
    base = edges.select(F.col("edge_id").alias("corridor_id"), F.col("line").alias("base"))
    both = lines.join(base, "corridor_id")
    width = lambda p: F.cos(F.radians(p["lat"])) * geo.METRES_PER_DEGREE

    def vector(a: Column, b: Column) -> tuple[Column, Column]:
        return (b["lon"] - a["lon"]) * width(a), (b["lat"] - a["lat"]) * geo.METRES_PER_DEGREE

    first, last, start, end = F.get("line", F.lit(0)), F.element_at("line", -1), F.get("base", F.lit(0)), F.element_at("base", -1)
    middle = F.get("line", F.floor(F.size("line") / 2).cast("int"))
    (rx, ry), (ix, iy), (ox, oy) = vector(start, end), vector(first, last), vector(start, middle)
    length = F.hypot(rx, ry)
    own = (F.col("edge_id") == F.col("corridor_id")) | (length < 1)
    offset = F.when(own, 0.0).otherwise((rx * oy - ry * ox) / length)
    return both.select("edge_id", "corridor_id", offset.alias("offset_m"), F.when(own | (ix * rx + iy * ry >= 0), 1).otherwise(-1).alias("alignment"))
