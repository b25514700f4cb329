"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set of shingles has a signature of COORDINATES minimum hashes. Documents with the same set are
one class, which its smallest doc_id stands for. A class is posted under (coordinate, value) pairs; the
lists of these posts are the inverted index:

* Prefix: classes that agree on MATCHES of COORDINATES pairs share one of the first COORDINATES - MATCHES + 1
  pairs of either, in any order that is the same for all. The order is by how often a pair occurs (a
  fixed-size table of counts over all classes), rare ones first, so the long lists are mostly left out.
* Count: where two classes meet in a list, the coordinates on which they collide are counted, and only
  pairs with MATCHES collisions or more are retained. The counting is done inside the list, over arrays of
  signatures, so two classes that meet by chance never become a row.
* Skip, by hubs: in a short list every class may be a hub, in a long one about HUBS of them are. Each class
  is compared with the hub it collides with most; links join classes to components. Classes of one component
  need no further comparison, so a group of near copies costs a few times its size.
* Skip, by groups: what is still apart is compared in blocks. A class belongs to the group (component) of its
  hub. Within a group, the members outside its component meet all others block by block; between groups, only
  blocks with a retained pair in some list meet. No pair is left out, and none is a row of its own.

Links are decided exactly, on the full shingle sets of the whole texts. A pair of similarity s is a
candidate unless fewer than MATCHES of COORDINATES collide; at s = 0.8 that has a probability of about
1e-6 with 80 of 128, and less above. Sets of fewer than 4 shingles are never within 0.8 of another set, so
they are not posted.

Defined results
* text null or without words: the set is empty, n_shingles 0, linked with nothing, its own component.
* fewer words than a shingle: the whole sequence is the one shingle.
* rows that share a doc_id are one node, linked by any of its texts, in one component. Rows without a doc_id
  are one node per text and come after all ids; a component without any id has a null component_id. Empty table:
  empty result.
* other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts
from pathloom.llm.bytebpe import binaries
from pathloom.llm.quotes import numbered
from pathloom.operators.graph import components

COORDINATES, MATCHES = 128, 80
SHINGLE, PERCENT = 5, 80
#: Cells of the table of counts; its size doesn't grow with the data.
CELLS = 1 << 21
SLOTS = 64  # parts in which the table of counts is summed
#: Members of a list up to which all may be hubs, and about how many are in a longer one.
ALL_HUBS, HUBS = 64, 32
#: Members of a list that one piece of work holds; members of a list that are compared by shifted rows.
LIST_ROWS, SHORT_LIST = 4096, 16
HUB_TURNS = 2  # with other hubs of the long lists each time; what they leave is compared in blocks
#: Pairs and shingles of a group in which hubs are compared with their members.
PAIRS, PAIR_SHINGLES = 256, 400_000
#: Classes and shingles of a block; classes of a meeting of blocks from which it is a group of its own, and
#: classes of the groups in which smaller meetings share.
BLOCK_CLASSES, BLOCK_SHINGLES, OWN_GROUP, SHARED_GROUP = 1024, 400_000, 128, 2048
#: Nodes of rows without a doc_id: from here on, by a hash of the text.
NAMELESS = 1 << 62
SET_SEED, SECOND_BASE = 0x589965CC75374CC3, 0x1D8E4E27C47D124F  # fixed values: seeds of the set digest


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending in each, and the offsets of the texts in them."""
    data = ts.LOWER[data]
    starts, ends, first = ts.words(data, offsets)
    hashes = ts.span_hashes(data, starts, ends)
    counts = np.diff(first)
    at, owner = ts.windows(first, size)
    value = ts.rolling(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = []
        for d in short:
            words = hashes[first[d] : first[d + 1]]
            whole.append(ts.mix(ts.rolling(words, len(words)) + np.uint64(len(words)))[0])
        value, owner = np.concatenate([value, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(offsets)))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = ts.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(SET_SEED))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(value: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) minimum hashes of 32 bits; of an empty set all bits are set."""
    factor, shift = _constants(n)
    full = np.flatnonzero(np.diff(at))
    out = np.full((len(at) - 1, n), 0xFFFFFFFF, np.uint32)
    if len(full):
        for k in range(n):
            out[full, k] = np.minimum.reduceat(((value * factor[k] + shift[k]) >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def _digest(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits that tell a set from others: two sums of mixed members and the number of them."""
    sums = []
    for seed in (SET_SEED, SECOND_BASE):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(ts.mix(value ^ np.uint64(seed)), out=total[1:])
        sums.append(total[at[1:]] - total[at[:-1]])
    both = np.stack(sums, axis=1)
    return [row.tobytes() for row in both]


def _describe(size: int, n: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ts.texts(batches):
            value, at = shingles(data, offsets, size)
            count = np.diff(at)
            full = count > 0
            sign = signatures(value, at, n)[full]
            begin = np.concatenate([[0], full.cumsum()])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("node"), pa.array(count), pa.array(_digest(value, at), pa.binary()),
                    binaries(sign.view(np.uint8).ravel(), begin * (4 * n)), binaries(_packed(sign).ravel(), begin * ((n + 1) // 2)),
                ],
                ["node", "n", "digest", "signature", "low"],
            )

    return describe


def _packed(sign: np.ndarray) -> np.ndarray:
    """The low four bits of each coordinate, two in a byte."""
    low, half = (sign & np.uint32(15)).astype(np.uint8), (sign.shape[1] + 1) // 2
    out = low[:, :half].copy()
    out[:, : low.shape[1] - half] |= low[:, half:] << 4
    return out


def _unpacked(packed: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) low bits, as ``_packed`` took them."""
    return np.concatenate([packed & 15, packed >> 4], axis=1)[:, :n]


def _pair_hash(sign: np.ndarray) -> np.ndarray:
    """A 64-bit value for each (coordinate, value) pair of the signatures."""
    return ts.mix(sign.astype(np.uint64) | (np.arange(sign.shape[1], dtype=np.uint64) << np.uint64(32)))


def _matrix(column: pa.Array, n: int, kind: type = np.uint32) -> np.ndarray:
    data, _ = ts.buffers(column)
    return np.frombuffer(data.tobytes(), kind).reshape(-1, n)


def _count(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.int64)
        for batch in batches:
            pairs = _pair_hash(_matrix(batch.column("signature"), n))
            table += np.bincount((pairs & np.uint64(CELLS - 1)).astype(np.int64).ravel(), minlength=CELLS)
        if table.any():
            parts = table.reshape(SLOTS, -1)
            yield pa.RecordBatch.from_pydict({"slot": np.arange(SLOTS), "counts": pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())})

    return count


def _add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS // SLOTS, np.int64)
    for batch in tables:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), "<i8")
    yield pa.RecordBatch.from_pydict({"slot": [key[0].as_py()], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _post(n: int, prefix: int, counts):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, "<i8")
        for batch in batches:
            pairs = _pair_hash(_matrix(batch.column("signature"), n))
            often = table[(pairs & np.uint64(CELLS - 1)).astype(np.int64)]
            # one order for all classes: by count, then by value
            by_value = np.argsort(pairs, axis=1)
            order = np.take_along_axis(by_value, np.argsort(np.take_along_axis(often, by_value, 1), axis=1, kind="stable"), 1)[:, :prefix]
            chosen = np.take_along_axis(pairs, order, 1)
            rows = pa.array(np.repeat(np.arange(len(pairs)), prefix))
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel().view(np.int64)), batch.column("node").take(rows)], ["pair", "node"])

    return post


class Lists:
    """Whole pieces of lists, one after another, with the columns of their members as arrays."""

    def __init__(self, rows: pa.Table, coordinates: int):
        self.low = _unpacked(_matrix(rows["low"], (coordinates + 1) // 2, np.uint8), coordinates)
        self.columns = {c: rows[c].to_numpy() for c in rows.column_names if c != "low"}
        self.begin = np.flatnonzero(_begins(rows))
        self.end = np.append(self.begin[1:], rows.num_rows)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def may_link(self, rows: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
        """Whether the members aren't in one component and their sizes allow a link."""
        x, y = self["n"][rows], self["n"][others]
        return (self["label"][rows] != self["label"][others]) & (100 * x >= percent * y) & (100 * y >= percent * x)

    def collisions(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """On how many coordinates the members collide, by the low bits of the values: never less than there are."""
        same = (self.low[rows] == self.low[others]).view(np.uint8)
        if same.shape[1] % 8 or same.shape[1] > 248:
            return same.sum(axis=1, dtype=np.int64)
        lanes = same.view(np.uint64).sum(axis=1)  # eight counts of at most 31 side by side
        return ((lanes * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)

    def short_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of members of the short lists, by shifted rows."""
        size = self.end - self.begin
        left = np.repeat(np.where(size <= SHORT_LIST, self.end, 0), size)
        for d in range(1, SHORT_LIST):
            one = np.flatnonzero(np.arange(len(left)) + d < left)
            if not len(one):
                return
            yield one, one + d

    def long(self) -> Iterator[np.ndarray]:
        """The members of each other list."""
        for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            if b - a > SHORT_LIST:
                yield np.arange(a, b)


def _begins(rows: pa.Table) -> np.ndarray:
    pair, part = rows["pair"].to_numpy(), rows["part"].to_numpy()
    new = np.ones(rows.num_rows, bool)
    new[1:] = (pair[1:] != pair[:-1]) | (part[1:] != part[:-1])
    return new


def _lists(batches: Iterator[pa.RecordBatch], coordinates: int, rows: int = 20_000) -> Iterator[Lists]:
    """Sorted posts cut between lists, about ``rows`` at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_begins(table))[-1])
            if last:
                yield Lists(table.slice(0, last).combine_chunks(), coordinates)
            held = table.slice(last).combine_chunks().to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield Lists(table.combine_chunks(), coordinates)


def _nearest(coordinates: int, matches: int, percent: int):
    """For each member of a list the hub in it that it collides with most, if on ``matches`` coordinates."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _lists(batches, coordinates):
            found = [np.zeros((0, 3), np.int64)]

            def retained(rows: np.ndarray, hubs: np.ndarray, lists: Lists = lists, found: list = found) -> None:
                may = lists.may_link(rows, hubs, percent)
                rows, hubs = rows[may], hubs[may]
                count = lists.collisions(rows, hubs)
                hit = count >= matches
                found.append(np.stack([rows[hit], hubs[hit], count[hit]], axis=1))

            for one, two in lists.short_pairs():
                for rows, hubs in ((one, two), (two, one)):
                    retained(rows[lists["hub"][hubs]], hubs[lists["hub"][hubs]])
            for members in lists.long():
                for hub in members[lists["hub"][members]].tolist():
                    retained(members, np.full(len(members), hub))
            every = np.concatenate(found)
            every = every[np.lexsort((lists["node"][every[:, 1]], -every[:, 2], every[:, 0]))]
            best = np.ones(len(every), bool)
            best[1:] = every[1:, 0] != every[:-1, 0]
            row, hub, count = every[best].T
            node = lists["node"]
            yield pa.RecordBatch.from_pydict({"pair": lists["pair"][row], "node": node[row], "hub": node[hub], "n": lists["n"][row] + lists["n"][hub], "matches": count})

    return nearest


def _crossing(coordinates: int, matches: int, percent: int):
    """The pairs of blocks of different groups with members that collide on ``matches`` coordinates."""

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _lists(batches, coordinates):
            found = [np.zeros((0, 2), np.int64)]

            def retained(one: np.ndarray, two: np.ndarray, lists: Lists = lists, found: list = found) -> None:
                may = (lists["group"][one] != lists["group"][two]) & lists.may_link(one, two, percent)
                one, two = one[may], two[may]
                hit = lists.collisions(one, two) >= matches
                blocks = np.stack([lists["block"][one[hit]], lists["block"][two[hit]]], axis=1)
                found.append(np.unique(np.sort(blocks, axis=1), axis=0))

            for one, two in lists.short_pairs():
                retained(one, two)
            for members in lists.long():
                names, count = np.unique(lists["group"][members], return_counts=True)
                for row in members[lists["group"][members] != names[count.argmax()]].tolist():  # each other pair is in the largest group
                    retained(np.full(len(members), row), members)
            every = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_pydict({"one": every[:, 0], "two": every[:, 1]})

    return crossing


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of 0-1 matrices over the shared members."""
    parts = [(np.concatenate([sets[i] for i in side]), np.repeat(np.arange(len(side)), [len(sets[i]) for i in side])) for side in (rows, columns)]
    common = np.intersect1d(parts[0][0], parts[1][0])
    out = np.zeros((len(rows), len(columns)), np.float32)
    for a in range(0, len(common), 4096):
        some = common[a : a + 4096]
        both = []
        for (value, owner), side in zip(parts, (rows, columns), strict=True):
            at = np.searchsorted(some, value)
            hit = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == value)
            matrix = np.zeros((len(side), len(some)), np.float32)
            matrix[owner[hit], at[hit]] = 1
            both.append(matrix)
        out += both[0] @ both[1].T
    return out.astype(np.int64)


def _sets(members: pa.Table, size: int) -> list[np.ndarray]:
    sets: list[np.ndarray] = []
    for _, data, offsets in ts.texts(iter(members.combine_chunks().to_batches())):
        value, at = shingles(data, offsets, size)
        sets += np.split(value, at[1:-1])
    return sets


def _places(names: np.ndarray) -> dict[int, np.ndarray]:
    """Where each name stands."""
    order = np.argsort(names, kind="stable")
    distinct, begin = np.unique(names[order], return_index=True)
    return dict(zip(distinct.tolist(), np.split(order, begin[1:]), strict=True))


def _links(found: list[np.ndarray]) -> pa.Table:
    every = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
    return pa.table({"a": every[:, 0], "b": every[:, 1]})


def _linked_pairs(size: int, percent: int):
    """The pairs (a, b) of a group whose shingle sets are within ``percent``."""

    def linked(key: tuple[pa.Scalar, ...], pairs: pa.Table, members: pa.Table) -> pa.Table:
        found = []
        if pairs.num_rows and members.num_rows:
            sets, places = _sets(members, size), _places(members["node"].to_numpy())
            for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
                hit = [len(x) + len(y) for i in places.get(a, ()) for j in places.get(b, ()) for x, y in [(sets[i], sets[j])] if _within(x, y, percent)]
                if hit:
                    found.append(np.array([[a, b]]))
        return _links(found)

    return linked


def _within(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked_blocks(size: int, percent: int):
    """The links between different components of the block pairs of a group."""

    def linked(key: tuple[pa.Scalar, ...], meetings: pa.Table, members: pa.Table) -> pa.Table:
        found = []
        if meetings.num_rows and members.num_rows:
            sets, places = _sets(members, size), _places(members["block"].to_numpy())
            label, node = members["label"].to_numpy(), members["node"].to_numpy()
            n = np.array([len(x) for x in sets])
            for one, two in zip(meetings["one"].to_pylist(), meetings["two"].to_pylist(), strict=True):
                if one not in places or two not in places:
                    continue
                rows, columns = places[one], places[two]
                x, y = n[rows][:, None], n[columns][None, :]
                may = (label[rows][:, None] != label[columns][None, :]) & (100 * x >= percent * y) & (100 * y >= percent * x) & (x > 0)
                rows, columns, may = rows[may.any(1)], columns[may.any(0)], may[may.any(1)][:, may.any(0)]
                if not len(rows):
                    continue
                both = _overlaps(sets, rows, columns)
                hit = np.argwhere(may & (100 * both >= percent * (n[rows][:, None] + n[columns][None, :] - both)))
                found.append(np.stack([node[rows[hit[:, 0]]], node[columns[hit[:, 1]]]], axis=1))
        return _links(found)

    return linked


def _with_texts(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked`` (settled rows with a node) with the node's text."""
    return nodes.join(shared.modest(asked), "node")


class _Search:
    """The stages of one search; each settles what later ones read and drops what none reads any more."""

    def __init__(self, nodes: DataFrame, shingle: int, percent: int, coordinates: int, matches: int):
        self.spark, self.shingle, self.percent, self.coordinates, self.matches = nodes.sparkSession, shingle, percent, coordinates, matches
        self.rounds = shared.Rounds(self.spark, "near")
        self.nodes = nodes
        shared.arrow_rows(self.spark)

    def describe(self) -> None:
        """All rows with their set's digest, and the classes with their signatures."""
        schema = "node long, n long, digest binary, signature binary, low binary"
        described = self.rounds.settle(self.nodes.mapInArrow(_describe(self.shingle, self.coordinates), schema), "described")
        first = {c: F.min_by(c, "node").alias(c) for c in ("signature", "low")}
        self.classes = self.rounds.settle(described.filter("n > 0").groupBy("digest", "n").agg(F.min("node").alias("class"), *first.values()), "classes")
        self.rows = self.rounds.settle(described.select("node", "n", "digest"), "rows")
        self.rounds.drop("described")

    @property
    def posted(self) -> DataFrame:
        """The classes whose sets are large enough to have another in reach."""
        least = math.ceil(self.percent / (100 - self.percent)) if self.percent < 100 else 1 << 62
        return self.classes.filter(F.col("n") >= least).withColumnRenamed("class", "node").drop("digest")

    def post(self) -> None:
        """The lists of two classes or more: pair, c (members), node."""
        summed = self.posted.select("signature").mapInArrow(_count(self.coordinates), "slot long, counts binary").groupBy("slot").applyInArrow(_add, "slot long, counts binary")
        rows = {r["slot"]: bytes(r["counts"]) for r in summed.collect()}  # CELLS counts, whatever the data
        counts = self.spark.sparkContext.broadcast(b"".join(rows.get(s, bytes(8 * CELLS // SLOTS)) for s in range(SLOTS)))
        prefix = self.coordinates - self.matches + 1
        posts = self.posted.select("node", "signature").mapInArrow(_post(self.coordinates, prefix, counts), "pair long, node long").repartition("pair")
        # a class is in a list once; asked for the nodes, both sides of the join read one exchange
        lists = posts.groupBy("pair").agg(F.count("*").alias("c"), F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b")
        self.posts = self.rounds.settle(posts.join(lists, "pair").select("pair", "c", "node"), "posts")
        self.classes = self.rounds.replace(self.classes.drop("signature"), "classes")

    def _in_lists(self, posts: DataFrame, state: DataFrame, part: Column, function, schema: str, columns: list) -> DataFrame:
        """``function`` over the posts sorted by (pair, part), with the state of their nodes."""
        placed = posts.join(state, "node").withColumn("_parts", F.ceil(F.col("c") / LIST_ROWS)).withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_parts")))
        placed = placed.withColumn("part", F.explode(part)).select("pair", "part", "node", "n", "label", "low", *columns)
        return placed.repartition("pair", "part").sortWithinPartitions("pair", "part").mapInArrow(function(self.coordinates, self.matches, self.percent), schema)

    def hubs(self, labels: DataFrame | None, turn: int) -> DataFrame:
        """pair, node, hub, n (of both), matches: for each post the nearest hub of its list in another component."""
        posts = self.posts if turn == 0 else self.posts.filter(F.col("c") > ALL_HUBS)
        state = self._labelled(self.posted.select("node", "n", "low"), labels)
        chosen = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) * F.col("c") < HUBS << 20
        posts = posts.withColumn("hub", (F.col("c") <= ALL_HUBS) | chosen)
        part = F.when(F.col("hub") & (F.col("_parts") > 1), F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).otherwise(F.array("_mine"))
        schema = "pair long, node long, hub long, n long, matches long"
        return self.rounds.settle(self._in_lists(posts, state, part, _nearest, schema, ["hub"]), "met")

    @staticmethod
    def _labelled(state: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return state.withColumn("label", F.col("node"))
        return state.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))

    def best(self, met: DataFrame) -> DataFrame:
        """node, hub, n: the hub of all its lists that a node collides with most."""
        rank = F.col("matches") * 1024 + F.pmod(F.xxhash64("hub"), F.lit(1024))
        return self.rounds.settle(met.groupBy("node").agg(F.max_by(F.struct("hub", "n"), rank).alias("_h")).select("node", "_h.hub", "_h.n"), "best")

    def confirm(self, best: DataFrame, turn: int) -> DataFrame:
        """The links (a, b) among nodes and their hubs, by full sets."""
        rank = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(1 << 20))  # noqa: E731  low for the hubs of long lists
        hub_first = (rank("hub") < rank("node")) | ((rank("hub") == rank("node")) & (F.col("hub") < F.col("node")))
        pairs = best.select(F.when(hub_first, F.col("hub")).otherwise(F.col("node")).alias("a"), F.when(hub_first, F.col("node")).otherwise(F.col("hub")).alias("b"), "n").distinct()
        total = pairs.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
        groups = 1 + max(total["c"] // PAIRS, (total["n"] or 0) // PAIR_SHINGLES)
        sizes = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / PAIRS), F.ceil(F.sum("n") / PAIR_SHINGLES)).alias("parts"))
        part = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))), F.lit(groups))
        dealt = self.rounds.settle(pairs.join(sizes, "a").select("a", "b", part.alias("part")), "dealt")
        asked = dealt.select("part", F.col("a").alias("node")).unionByName(dealt.select("part", F.col("b").alias("node"))).distinct()
        members = _with_texts(self.rounds.settle(asked, "asked"), self.nodes).select(F.col("part").alias("group"), "node", "text")
        found = dealt.groupBy("part").cogroup(members.groupBy("group")).applyInArrow(_linked_pairs(self.shingle, self.percent), "a long, b long")
        found = self.rounds.settle(found, "links")
        self.rounds.drop("dealt", "asked")
        return found

    def rest(self, labels: DataFrame, best: DataFrame, met: DataFrame) -> DataFrame:
        """The links between members of a list that are in different components."""
        held = self._labelled(self.posted.select("node", "n"), labels)
        of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("group"))
        grouped = held.join(best.select("node", "hub"), "node", "left").join(of_hub, "hub", "left").withColumn("group", F.coalesce("group", "hub", "label"))
        grouped = self.rounds.settle(grouped.select("node", "n", "label", "group"), "grouped")
        is_open = F.col("label") != F.col("group")
        needed = lambda n, c: F.greatest(F.lit(1), F.ceil(c / BLOCK_CLASSES), F.ceil(n / BLOCK_SHINGLES))
        counted = grouped.groupBy("group").agg(
            needed(F.sum("n"), F.count("*")).alias("blocks"), needed(F.sum(F.when(is_open, F.col("n"))), F.count_if(is_open)).alias("open_blocks"), F.count("*").alias("c"), F.count_if(is_open).alias("c_open"),
        )
        counted = self.rounds.settle(counted.filter("c > 1"), "counted")
        every = lambda group, k: F.xxhash64(group, F.lit(0), k)
        apart = lambda group, k: F.xxhash64(group, F.lit(1), k)
        placed = grouped.join(counted, "group", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1).cast("long")), "open_blocks": F.coalesce("open_blocks", F.lit(1).cast("long"))})
        mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        placed = self.rounds.settle(placed.select("node", "n", "label", "group", every("group", mine("blocks")).alias("block"), F.when(is_open, apart("group", mine("open_blocks"))).alias("open_block")), "placed")

        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        within = counted.filter("c_open > 0").select("group", "blocks", numbers("open_blocks").alias("i")).select("group", "i", numbers("blocks").alias("j"))
        within = within.select(apart("group", F.col("i")).alias("one"), every("group", F.col("j")).alias("two"))

        kept = met.select("pair").distinct()  # short lists were counted whole: the others have no pair to retain
        lists = self.posts.filter(F.col("c") <= ALL_HUBS).join(kept, "pair", "left_semi").unionByName(self.posts.filter(F.col("c") > ALL_HUBS))
        state = placed.select("node", "label", "group", "block").join(self.posted.select("node", "n", "low"), "node")
        others = F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)
        cells = F.transform(others, lambda i: F.least(i, F.col("_mine")) * F.col("_parts") + F.greatest(i, F.col("_mine")))
        between = self._in_lists(lists, state, cells, _crossing, "one long, two long", ["group", "block"])
        meetings = self.rounds.settle(within.unionByName(between).distinct(), "meetings")

        blocks = placed.select("block", "node", "label").unionByName(placed.filter("open_block is not null").select(F.col("open_block").alias("block"), "node", "label"))
        sizes = blocks.groupBy("block").agg(F.count("*").alias("c"))
        weighed = meetings
        for side in ("one", "two"):
            weighed = weighed.join(sizes.select(F.col("block").alias(side), F.col("c").alias(f"c_{side}")), side)
        weighed = self.rounds.settle(weighed.select("one", "two", (F.col("c_one") + F.col("c_two")).alias("weight")), "weighed")
        light = weighed.agg(F.sum(F.when(F.col("weight") < OWN_GROUP, F.col("weight")))).first()[0] or 0
        own = F.xxhash64("one", "two")
        part = F.when(F.col("weight") < OWN_GROUP, F.pmod(own, F.lit(1 + light // SHARED_GROUP))).otherwise(own)
        dealt = self.rounds.settle(weighed.select("one", "two", part.alias("part")), "dealt")
        sides = dealt.select("part", F.col("one").alias("block")).unionByName(dealt.select("part", F.col("two").alias("block"))).distinct()
        asked = self.rounds.settle(blocks.join(sides, "block"), "asked")
        members = _with_texts(asked, self.nodes).select(F.col("part").alias("group"), "block", "node", "label", "text")
        found = dealt.groupBy("part").cogroup(members.groupBy("group")).applyInArrow(_linked_blocks(self.shingle, self.percent), "a long, b long")
        found = self.rounds.settle(found, "links")
        self.rounds.drop("dealt", "asked", "weighed", "meetings", "placed", "counted", "grouped")
        return found

    def run(self) -> DataFrame:
        """The rows (node, n) with the component of their node."""
        self.describe()
        self.post()
        met = self.hubs(None, 0)
        best = self.best(met)
        links = self.confirm(best, 0)
        labels = components(links)
        for turn in range(1, HUB_TURNS):
            more = self.confirm(self.best(self.hubs(labels, turn)), turn)
            links = self.rounds.settle(links.unionByName(more), "links")
            labels = components(links)
        links = links.unionByName(self.rest(labels, best, met))
        # the classes of a node's texts are linked
        named = self.rounds.settle(self.rows.filter("n > 0").join(self.classes.select("digest", "n", "class"), ["digest", "n"]).select("node", "class"), "named")
        several = named.groupBy("node").agg(F.min("class").alias("a"), F.max("class").alias("_b")).filter("a <> _b")
        reached = components(links.unionByName(several.join(named, "node").select("a", F.col("class").alias("b")).filter("a <> b")))
        found = named.join(reached.withColumnRenamed("node", "class"), "class", "left").groupBy("node").agg(F.min(F.coalesce("component", "class")).alias("component"))
        found = self.rounds.settle(found, "found")
        self.rounds.drop("posts", "met", "best", "links", "classes", "named")
        return self.rows.select("node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached by links), kept (doc_id = component_id), node.

    Two documents are linked when 100 * intersection >= percent * union of their sets of distinct shingles
    of ``shingle`` words, after lower-casing A-Z.
    """
    return _judged(docs, Nodes(docs), shingle, percent, coordinates, matches)


def _judged(docs: DataFrame, nodes: Nodes, shingle: int, percent: int, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    out = nodes.named(_Search(nodes.of(docs).select("node", "text"), shingle, percent, coordinates, matches).run())
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("node") == F.col("component")).alias("kept"), "node")


class Nodes:
    """One number for each doc_id, in the order of the ids, and above them one for each text without an id.

    Ids below NAMELESS are their own numbers; so are all ids where no row lacks one. Else the distinct ids are numbered.
    """

    def __init__(self, docs: DataFrame):
        id_ = F.col("doc_id").cast("long")
        size = docs.agg(F.max(id_).alias("top"), F.count_if(id_.isNull()).alias("nameless")).first()
        self.nameless, self.numbers = bool(size["nameless"]), None
        if self.nameless and (size["top"] or 0) >= NAMELESS:
            ids = docs.select(id_.alias("doc_id")).filter("doc_id is not null").distinct().withColumn("all", F.lit(0))
            self.numbers = shared.settle(numbered(ids, ["doc_id"], "all", "number").drop("all"), "numbers")

    def of(self, docs: DataFrame) -> DataFrame:
        """row (a struct of all columns), text and node of each row."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))
        own = "doc_id"
        if self.numbers is not None:
            rows, own = rows.join(self.numbers, "doc_id", "left"), "number"
        return rows.select("row", "text", F.coalesce(own, F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS))).alias("node"))

    def named(self, found: DataFrame) -> DataFrame:
        """``found`` (node, component) with doc_id and component_id; null where they stand for rows without an id."""
        for node, name in (("node", "doc_id"), ("component", "component_id")):
            if self.numbers is not None:
                found = found.join(self.numbers.select(F.col("number").alias(node), F.col("doc_id").alias(name)), node, "left")
            else:
                found = found.withColumn(name, F.when(F.col(node) < NAMELESS, F.col(node)) if self.nameless else F.col(node))
        return found


def representatives(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their own columns."""
    nodes = Nodes(docs)
    gone = _judged(docs, nodes, shingle, percent).filter("not kept").select("node").distinct()
    gone = shared.modest(shared.settle(gone, "gone"))
    return nodes.of(docs).select("row", "node").join(gone, "node", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
