"""Ranked lexical search: the best documents for each item by windowed bucket scoring.

Documents are reduced to their length and the places in the vocabulary of the items' terms that they hold, sorted
by doc_id and cut into fixed windows of WINDOW documents. In a window the postings lie term after term, each with
its impact. An item's postings are scatter-added to an array of one window, which stays in the processor's cache;
an occupancy bitset, ORed from masks of the postings, tells which of its buckets were hit; those are harvested into
the item's heap of the best, and only they are cleared. Heaps of all tasks meet in two steps of ranks by item.

The scan of texts shuffles nothing; what is shuffled afterwards is a few numbers per document, in ranges of doc_id.
No task holds more than a window of documents and the heaps of a block of items. Items are taken in blocks of about
MOST_PAIRS terms together (one item is never cut), so what is broadcast stays below a few megabytes.

score = sum over the item's distinct terms of w * ((10 ** 9 * tf) div (1000 * tf + 20 * m)), with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 50 + (50 * n * N) div L, in 64-bit integers.

Defined results
* null text: no terms; such a document counts nowhere, such an item has no rows. Empty tables: empty result.
* rows that share an id are documents or items of their own. A null doc_id comes last among equal scores.
* items with equal texts have equal rows; columns beside the ids and texts are not read.
* a term is told by a 64-bit hash; terms of up to eight bytes never collide with one of the same length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts

#: Documents of a window: an array of 64 bits for each fits the second-level cache. Best documents of an item.
WINDOW, BEST = 1 << 14, 50
#: Terms of all items of a block together: a bound for what is broadcast and for the heaps of a task.
MOST_PAIRS = 1 << 17
#: Bits of the table that tells most of the words which aren't in the vocabulary.
FILTER_BITS = 20
SALTS = 64
#: The bytes of terms: ASCII letters and digits and whatever isn't ASCII.
IS_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of some texts, in order, and the n + 1 places of the texts' first terms."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = IS_TERM[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    inner = offsets[1:-1]
    edge[inner[(inner > 0) & (inner < len(data))]] = True
    starts, ends = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside) + 1
    return ts.span_hashes(ts.LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def asked_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ts.texts(batches):
            hashes, first = terms(data, offsets)
            each = [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            owner = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            found = np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("item").take(owner), rows.column("item_id").take(owner), pa.array(found)], ["item", "item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    plain = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return plain.mapInArrow(run, f"item long, item_id {kind}, term long")


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms of the whole text), places (in the sorted ``vocabulary``) and tfs of documents with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    shared.arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, low = sent.value, np.uint64((1 << FILTER_BITS) - 1)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[ts.mix(known) & low] = True
        for rows, data, offsets in ts.texts(batches):
            hashes, first = terms(data, offsets)
            n = np.diff(first)
            some = np.flatnonzero(maybe[ts.mix(hashes) & low])
            place = np.minimum(np.searchsorted(known, hashes[some]), max(len(known) - 1, 0))
            hit = known[place] == hashes[some] if len(known) else np.zeros(len(some), bool)
            owner = np.searchsorted(first, some[hit], "right") - 1
            pairs, tf = np.unique(owner * max(len(known), 1) + place[hit], return_counts=True)
            doc, place = np.divmod(pairs, max(len(known), 1))
            full = np.flatnonzero(n)
            bounds = pa.array(np.append(np.searchsorted(doc, full), len(doc)), pa.int32())
            listed = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (place, tf)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(full)), pa.array(n[full]), *listed], ["doc_id", "n", "places", "tfs"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n long, places array<int>, tfs array<int>")


class Heap:
    """The best documents of an item so far: scores, ids and whether there is an id, best first."""

    __slots__ = ("ids", "known", "scores")

    def __init__(self) -> None:
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def push(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray, best: int) -> None:
        if len(self.scores) >= best:  # an equal score may have a smaller id
            fit = np.flatnonzero(scores >= self.scores[-1])
            if not len(fit):
                return
            scores, ids, known = scores[fit], ids[fit], known[fit]
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -scores))[:best]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


class Scorer:
    """Scores windows of documents for all items of a block."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, best: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.best = items, weights, n_docs, n_terms, best
        self.heaps = [Heap() for _ in items]
        self.buckets, self.hits = np.zeros(WINDOW, np.int64), np.zeros(WINDOW >> 6, np.uint64)

    def window(self, ids: np.ndarray, known: np.ndarray, n: np.ndarray, sizes: np.ndarray, places: np.ndarray, tfs: np.ndarray) -> None:
        """At most WINDOW documents: their ids, lengths, and postings document after document."""
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(places, kind="stable")
        doc, place, tf = doc[order], places[order], tfs[order]
        impact = self.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        at = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.weights)))])
        # a mask for each word of the bitset that a term's postings touch
        word, bit = doc >> 6, np.uint64(1) << (doc & 63).astype(np.uint64)
        new = np.ones(len(doc), bool)
        new[1:] = (word[1:] != word[:-1]) | (place[1:] != place[:-1])
        heads = np.flatnonzero(new)
        masks, words = (np.bitwise_or.reduceat(bit, heads), word[heads]) if len(heads) else (bit, word)
        mask_at = np.searchsorted(heads, at).tolist()
        at = at.tolist()
        buckets, hits = self.buckets, self.hits
        for item, own in enumerate(self.items):
            for t in own:
                a, b = at[t], at[t + 1]
                if a < b:
                    buckets[doc[a:b]] += impact[a:b]  # a document comes once in a term's postings
                    c, d = mask_at[t], mask_at[t + 1]
                    hits[words[c:d]] |= masks[c:d]
            touched = np.flatnonzero(hits)
            if len(touched):
                bits = np.unpackbits(hits[touched].view(np.uint8), bitorder="little").reshape(-1, 64)
                row, column = np.nonzero(bits)
                where = (touched[row] << 6) + column
                scores = buckets[where]
                above = scores > 0
                self.heaps[item].push(scores[above], ids[where[above]], known[where[above]], self.best)
                buckets[where], hits[touched] = 0, 0


def _scored(found: DataFrame, numbers: np.ndarray, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """item, salt, doc_id, score: the best of each item in each task; ``found`` is sorted by doc_id in ranges."""
    sent = found.sparkSession.sparkContext.broadcast((numbers, items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, items, weights = sent.value
        scorer = Scorer(items, weights, n_docs, n_terms, best)
        waiting, rows = [], 0

        def score() -> None:
            nonlocal waiting, rows
            if rows:
                table = pa.Table.from_batches(waiting).combine_chunks()
                ids, lists = table["doc_id"].combine_chunks(), [table[c].combine_chunks() for c in ("places", "tfs")]
                sizes = np.diff(lists[0].offsets.to_numpy())
                scorer.window(
                    ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), table["n"].to_numpy(), sizes, *(x.flatten().to_numpy().astype(np.int64) for x in lists)
                )
            waiting, rows = [], 0

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, WINDOW - rows)
                waiting.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == WINDOW:
                    score()
        score()
        salt = TaskContext.get().partitionId() % SALTS
        for item, heap in zip(numbers.tolist(), scorer.heaps, strict=True):
            if k := len(heap.scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * k), pa.array([salt] * k), pa.array(heap.ids, mask=~heap.known), pa.array(heap.scores)], ["item", "salt", "doc_id", "score"])

    return found.mapInArrow(run, "item long, salt long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``best`` documents (doc_id, text) with a score above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    asked = shared.settle(asked_terms(items), "asked")
    blocks = max(1, math.ceil(asked.count() / most_pairs))
    named = shared.modest(shared.settle(asked.select("item", "item_id").distinct(), "items"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    out = None
    for k in range(blocks):
        pairs = asked.filter(block == k).select("item", "term").toArrow()  # about most_pairs, or those of one item
        item, term = pairs["item"].to_numpy(), pairs["term"].to_numpy().view(np.uint64)
        vocabulary = np.unique(term)
        place, order = np.searchsorted(vocabulary, term), np.argsort(item, kind="stable")
        numbers, begin = np.unique(item[order], return_index=True)
        own = [x.tolist() for x in np.split(place[order], begin[1:])] if len(numbers) else []
        found = shared.settle(postings(docs, vocabulary), "postings")
        size = found.agg(F.count("*"), F.sum("n")).first()
        n_docs, n_terms = size[0], size[1] or 1
        counted = found.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df")).toArrow()  # a row per place in the vocabulary
        df = np.zeros(len(vocabulary), np.int64)
        df[counted["place"].to_numpy()] = counted["df"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        some = found.filter(F.size("places") > 0).withColumn("_s", F.xxhash64("n", "places", "tfs"))
        ranged = some.repartitionByRange("doc_id", "_s").sortWithinPartitions("doc_id").drop("_s")
        top = _scored(ranged, numbers, own, weights, n_docs, n_terms, best)
        out = top if out is None else out.unionByName(top)
    shared.arrow_rows(spark)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= best)
    few = ranked(ranked(out, "item", "salt").drop("rank", "salt"), "item")
    return few.join(named, "item").select("item_id", "rank", "doc_id", "score")
