"""The graph queries over all consecutive lines of every order, against brute force on a small table."""

from collections import Counter, defaultdict

import pytest

from pathloom.jobs import network_queries
from pathloom.operators import graph

#: Parts of each order, line by line: a grid with a tail, a chain with a stub, a ring, a pair.
ORDERS = {1: [1, 2, 3, 4, 5, 6, 7], 2: [1, 4], 3: [7, 8, 9], 4: [20, 21, 22, 23], 5: [22, 24], 6: [30, 31, 32, 30], 7: [40, 41], 8: [2, 2, 5], 9: [50], 10: [9, 10], 11: [8, 37]}
#: The barrier of the view; the view takes one part in 37.
GATES = (37,)
PAIRS = [(w, k, a, b) for w, parts in ORDERS.items() for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a != b]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("orders"))
    rows = [(w, k + 1, part, 1, 1.0, 10.0 + w, "NRA"[(w + k) % 3], "O") for w, parts in ORDERS.items() for k, part in enumerate(parts)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(f"{place}/lineitem.parquet")
    spark.createDataFrame([(n, 1) for n in (1, 24, 31, 37, 74)], "p_partkey long, p_size int").write.parquet(f"{place}/part.parquet")
    return place


def core():
    left = [(a, b) for _, _, a, b in PAIRS]
    while True:
        degree = Counter(n for pair in left for n in pair)
        kept = [p for p in left if min(degree[p[0]], degree[p[1]]) > 1]
        if len(kept) == len(left):
            return left
        left = kept


def around():
    near = defaultdict(set)
    for _, _, a, b in PAIRS:
        near[a].add(b)
        near[b].add(a)
    return near


def hops(sources):
    found, now = {n: 0.0 for n in sources}, set(sources)
    while now:
        now = {b for a in now for b in around()[a]} - set(found)
        found |= {n: max(found.values()) + 1 for n in now}
    return found


def test_whole_degrees(spark, sf_dir):
    got = {r.node: r.degree for r in network_queries.node_degrees(spark, sf_dir).collect()}
    assert got == Counter(n for _, _, a, b in PAIRS for n in (a, b))


def test_whole_components(spark, sf_dir):
    got = {r.node: r.component for r in network_queries.graph_components(spark, sf_dir).collect()}
    assert got == {n: min(hops([n])) for n in around()}


def test_whole_two_core(spark, sf_dir):
    got = {(r.src, r.dst): r.n for r in network_queries.graph_two_core(spark, sf_dir).collect()}
    assert got == Counter(core()) and len(got) < len({p[2:] for p in PAIRS})


def test_nearest_access_is_the_cheapest_way_to_a_gate(spark, sf_dir):
    found = {n: 0.0 for n in GATES if n in around()}
    for _ in range(len(PAIRS)):
        for w, _, a, b in PAIRS:
            for x, y in ((a, b), (b, a)):
                if found.get(x, 1e9) + 10.0 + w < found.get(y, 1e9):
                    found[y] = found[x] + 10.0 + w
    got = {r.node: r.cost for r in network_queries.nearest_access(spark, sf_dir).collect()}
    assert got == found and got[10] > 20 and 40 not in got


def test_costs_are_drawn_together_on_long_ways(spark, monkeypatch):
    """A chain of 40 nodes with a cheap way round: more rounds than DELTAS, and costs that fall late."""
    monkeypatch.setattr(graph, "DELTAS", 4)
    rows = [(k, k + 1, 5.0) for k in range(40)] + [(0, 100, 1.0), *((100 + k, 101 + k, 1.0) for k in range(25)), (125, 20, 1.0)]
    out = graph.cheapest(spark.createDataFrame(rows, "src long, dst long, weight double"), spark.createDataFrame([(7, 0)], "query long, node long"), origins=True).collect()
    got = {r.node: r.cost for r in out}
    assert got[20] == 27.0 and got[40] == 127.0 and got[15] == 52.0 and got[5] == 25.0 and len(out) == 67 and {r.origin for r in out} == {0}


def test_whole_contraction(spark, sf_dir):
    joints = {n for n, d in Counter(n for _, _, a, b in PAIRS for n in (a, b)).items() if d != 2}
    half = defaultdict(list)
    for w, k, a, b in PAIRS:
        half[a].append((w, k, b))
        half[b].append((w, k, a))
    want = Counter()
    for u in joints:
        for w, k, b in half[u]:
            line, length = [u, b], 10.0 + w
            while line[-1] not in joints:
                w, k, b = next(h for h in half[line[-1]] if h[:2] != (w, k))
                line.append(b)
                length += 10.0 + w
            want[min(tuple(line), tuple(line[::-1])), round(length, 3)] += 1
    want = Counter({k: n // 2 for k, n in want.items()})
    rows = network_queries.contracted_edges(spark, sf_dir).collect()
    lines = [tuple(map(int, r.nodes.split(","))) for r in rows]
    assert Counter((min(x, x[::-1]), r.length_m) for x, r in zip(lines, rows, strict=True)) == want
