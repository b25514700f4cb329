"""Graph jobs as rounds of joins: components, 2-core, cheapest access. Each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.network import small
from pathloom.sources import places

ROUNDS = 50
#: Rounds of a 2-core until one takes whole chains; tips (of eight bytes) up to which they are broadcast.
PEELS, MOST_TIPS = 8, 1_000_000
#: Tables of costs that fell until they are drawn together.
DELTAS = 16


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. ``links`` has columns a and b.

    Large-star and small-star rounds: every node sends its neighbours to the smallest of them, so long chains
    shrink in a logarithmic number of rounds and a hub never gathers pairs of its neighbours. Each round is
    written to the shared folder. Raises if ROUNDS don't suffice rather than stop early.
    """
    rounds = places.Rounds(links.sparkSession, "components")
    edges = rounds.replace(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    now = _content(edges)
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of a node move to its smallest neighbour (or to itself)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of a node, and the node itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = rounds.replace(small.filter("a <> b").distinct(), "links")
        seen, now = now, _content(edges)
        if seen == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"no end after {ROUNDS} rounds")


def _content(edges: DataFrame) -> tuple:
    """A count and a digest by which two sets of edges are told apart."""
    digest = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(digest, F.lit(1 << 31))), F.bit_xor(digest)).first())


def reachable(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(node): all nodes in a component with one of ``sources`` (column node), the sources included."""
    found = components(links)
    labels = sources.join(found, "node", "left").select(F.coalesce("component", "node").alias("component")).distinct()
    every = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).distinct()
    return every.join(labels, "component", "left_semi").select("node").unionByName(sources.select("node")).distinct()


def two_core(edges: DataFrame) -> DataFrame:
    """The edges (src, dst; parallel ones count) that remain when nodes of degree 1 go, again and again.

    Columns beside src and dst are kept. PEELS rounds take the tips alone: a count of degrees and an anti-join. If tips are
    left then, a round takes whole dead ends: the chains (components over nodes with two edges) that a tip ends, however
    long they are. So long chains don't cost a round for each step, and short ones don't cost a search for components.
    """
    rounds = places.Rounds(edges.sparkSession, "core")
    left, turn = rounds.replace(edges, "core"), 0
    while True:
        degree = left.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
        tips = rounds.replace(degree.filter("d = 1").select("node"), "tips")
        if not (n := tips.count()):
            rounds.drop("tips")
            return left
        turn += 1
        gone = F.broadcast(tips) if n <= MOST_TIPS else tips
        if turn % PEELS == 0:
            inner = degree.filter("d <= 2").select("node")
            chained = left.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi")
            chains = components(chained.select(F.col("src").alias("a"), F.col("dst").alias("b")))
            ended = tips.join(chains, "node", "left").select(F.coalesce("component", "node").alias("component")).distinct()
            gone = chains.join(ended, "component", "left_semi").select("node").unionByName(ended.select(F.col("component").alias("node"))).unionByName(tips).distinct()
        kept = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = rounds.replace(kept.select(*edges.columns), "core")


def cheapest(edges: DataFrame, sources: DataFrame, origins: bool = False) -> DataFrame:
    """(query, node, cost, parent): the cheapest cost from a source of the query to every node that it reaches.

    ``edges`` has src, dst and weight (used in both directions), ``sources`` query and node. Only nodes whose cost fell in
    the last round send on, and only costs that fell are written: a round appends its own table, and DELTAS of them are
    drawn together into one. parent is the neighbour before the node, null at a source; ties go to the smaller
    neighbour. With ``origins`` also the source that the cost is from.
    """
    rounds = places.Rounds(edges.sparkSession, "cheapest")
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = rounds.settle(both.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "arcs")
    start = sources.select("query", "node", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("parent"), F.col("node").alias("origin")).distinct()
    front = rounds.settle(start, "costs")
    known, deltas = front, 1
    best = lambda df: df.groupBy("query", "node").agg(F.min(F.struct("cost", "parent", "origin")).alias("b")).select("query", "node", "b.*")
    while not front.isEmpty():
        sent = front.join(both, F.col("node") == F.col("src")).filter("parent is null or dst <> parent")
        offers = best(sent.select("query", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("parent"), "origin"))
        held = known.groupBy("query", "node").agg(F.min("cost").alias("_held"))
        front = rounds.settle(offers.join(held, ["query", "node"], "left").filter("_held is null or cost < _held").drop("_held"), "costs")
        known, deltas = known.unionByName(front), deltas + 1
        if deltas == DELTAS:
            known, deltas = rounds.replace(best(known), "known"), 1
            front = known.join(front.select("query", "node", "cost"), ["query", "node", "cost"], "left_semi")
            front = rounds.replace(front, "costs")
    out = best(known)
    return out if origins else out.drop("origin")


def contract(steps: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Chains of nodes with two steps become one edge: edge_id, u, v, length_m, weight, polyline, highway, quality.

    ``steps`` has way_id and pos (together unique), src, dst, length_m, cost, highway and quality. Chains end at
    junctions: nodes whose number of steps isn't two, and the ``protected`` ones (column node). A ring without a
    junction disappears. Every direction of a step points to the one that follows it; the pointers are doubled, so
    a chain of n steps takes log2(n) rounds; steps between two junctions are no part of it. An edge runs from its smaller end, and has highway and quality of its
    first step there; weight is the sum of length times cost.
    """
    tables = places.Rounds(steps.sparkSession, "contract")
    ids = tables.settle(steps.select("way_id", "pos", "src", "dst", "length_m", "cost", "highway", "quality"), "steps")
    inner = ids.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).filter("d = 2").select("node")
    if protected is not None:
        inner = inner.join(protected.select("node"), "node", "left_anti")
    inner = small(tables.settle(inner, "inner").withColumn("inner", F.lit(True)))
    flags = [inner.select(F.col("node").alias(c), F.col("inner").alias(f"_{c}")) for c in ("src", "dst")]
    marked = ids.join(flags[0], "src", "left").join(flags[1], "dst", "left")
    alone = F.col("_src").isNull() & F.col("_dst").isNull()
    # a step between two junctions is an edge as it is
    ways = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    single = marked.filter(alone).withColumn("e", F.explode(F.filter(ways, lambda e: e["u"] <= e["v"])))
    single = single.select(F.concat_ws("-", "e.u", "way_id", "pos").alias("edge_id"), "e.u", "e.v", "length_m", (F.col("length_m") * F.col("cost")).alias("weight"), F.array("e.u", "e.v").alias("polyline"), "highway", "quality")
    ahead = marked.filter(~alone).withColumn("back", F.lit(0))
    behind = ahead.withColumns({"src": F.col("dst"), "dst": F.col("src"), "_src": F.col("_dst"), "_dst": F.col("_src"), "back": F.lit(1)})
    half = ahead.unionByName(behind).withColumn("h", F.struct("way_id", "pos", "back")).withColumn("end", F.col("_dst").isNull()).drop("_src", "_dst")
    half = tables.settle(half, "halves")
    out = half.select(F.col("src").alias("dst"), F.col("h").alias("next"))
    same = (F.col("next.way_id") == F.col("h.way_id")) & (F.col("next.pos") == F.col("h.pos"))
    follow = half.filter("not end").select("dst", "h").join(out, "dst").filter(~same).select("h", F.col("next").alias("to"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("done"))
    state = follow.unionByName(half.filter("end").select("h", F.col("h").alias("to"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("done")))
    state = tables.replace(state, "pointers")
    finished = state.filter("done").count()
    for _ in range(ROUNDS):
        beyond = state.select(F.col("h").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"), F.col("done").alias("there"))
        moved = state.filter("not done").join(beyond, "to").select("h", F.col("further").alias("to"), (F.col("n") + F.col("more")).alias("n"), F.col("there").alias("done"))
        state = tables.replace(state.filter("done").unionByName(moved), "pointers")
        finished, before = state.filter("done").count(), finished
        if finished == before:
            break
    else:
        raise RuntimeError(f"chains longer than 2 ** {ROUNDS}")
    whole = state.filter("done").select("h", "to", "n").join(half, "h")
    first = F.max_by(F.struct("src", "way_id", "pos", "highway", "quality"), "n")
    last = F.min_by(F.struct("dst", "way_id", "pos"), "n")
    nodes = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "dst"))), lambda x: x["dst"])
    chains = whole.groupBy("to").agg(first.alias("a"), last.alias("b"), F.sum("length_m").alias("length_m"), F.sum(F.col("length_m") * F.col("cost")).alias("weight"), nodes.alias("_n"))
    one = F.struct("a.src", "a.way_id", "a.pos") <= F.struct(F.col("b.dst").alias("src"), "b.way_id", "b.pos")
    kept = chains.filter(one)
    name = F.concat_ws("-", "a.src", "a.way_id", "a.pos")
    joined = kept.select(name.alias("edge_id"), F.col("a.src").alias("u"), F.col("b.dst").alias("v"), "length_m", "weight", F.concat(F.array("a.src"), F.col("_n")).alias("polyline"), "a.highway", "a.quality")
    return single.unionByName(joined)
