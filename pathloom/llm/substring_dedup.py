"""Substring dedup: repeated windows of words are removed, their first document excepted.

Every window of ``width`` consecutive words of every document gets a Rabin-Karp hash. Documents are dealt
into chunks by ranges of doc_id, so the order of ranges is the order of ids. A chunk sorts its windows once by
(bucket, hash), where an independent second hash names the bucket, and sends each bucket the values that it
has for it, each once. The bucket counts in which chunks a value occurs and answers one bit per value: does an
earlier chunk have it? Back in the chunk, repeats between documents of the same chunk are found by the same
values, and the windows to remove merge into maximal intervals.

What is shuffled: the texts by chunk, eight bytes per window, and one bit per window back. A chunk has a
message for each bucket that it has values for, never more than it has windows, and nothing else in a chunk
depends on the number of buckets. A window that all documents share occurs at most once per chunk, so no bucket
grows with the copies. The bounds of ranges are a fixed number (MOST_RANGES at most); a range of more bytes
than a chunk is cut by a hash into several chunks, whose values then carry the smallest doc_id that has them,
so that ranges with long documents, a repeated doc_id, or any size of table are split all the same. Two windows
count as equal when the 64-bit hash and the bucket of the second hash agree.

Defined results
* null text: no words, nothing removed, kept text empty (with ``cut`` null). Empty table: empty result.
* fewer than ``width`` words: nothing removed.
* rows that share a doc_id: neither is smaller, so neither loses words to the other.
* null doc_id: comes after all ids; it loses words to documents with ids, never to other null ids.
* columns beside doc_id and text travel inside the struct column ``row``, so names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts

WIDTH = 13
#: Bytes of text of a chunk, and windows of a bucket, that one task holds at once.
CHUNK_BYTES, BUCKET_WINDOWS = 4 << 20, 1 << 20
#: Ranges of doc_id at most, whatever the size of the table.
MOST_RANGES = 1 << 14
SECOND_BASE = 0xA0761D6478BD642F  # fixed value: odd multiplier of the second hash
LAST = np.iinfo(np.int64).max


def in_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, most_ranges: int = MOST_RANGES) -> tuple[DataFrame, int, int]:
    """(range, part, parts, doc_id, text, row), the number of ranges with ids, and the bytes of all texts.

    Ranges of doc_id have about equal numbers of rows; a range of over two times ``chunk_bytes`` has several
    parts. Rows without an id are a range of their own that comes after the others.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("ids")).first()
    total = size["bytes"] or 0
    n = min(max(1, math.ceil(total / chunk_bytes)), most_ranges)
    bounds = [0.0]
    if n > 1 and size["ids"]:
        shares = [k / n for k in range(1, n)]
        bounds = sorted({float(x) for x in docs.agg(F.percentile_approx("doc_id", shares, 20 * n)).first()[0]})
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("string").alias("none"))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_at", outputCol="_range", handleInvalid="keep")
    n_id = len(bounds) + 1
    ranged = lambda df: cut.transform(df.withColumn("_at", F.col("doc_id").cast("double"))).withColumn("range", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_range")), F.lit(n_id)).cast("int")).drop("_at", "_range")
    parts = F.ceil(F.sum(F.octet_length("text")) / chunk_bytes)
    sizes = ranged(docs.select("doc_id", "text")).groupBy("range").agg(F.when(parts > 2, parts).otherwise(1).cast("int").alias("parts"))
    split = F.broadcast(shared.settle(sizes.filter("parts > 1"), "ranges"))  # MOST_RANGES + 1 rows at most
    plain = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))).join(split, "range", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "text"), F.col("parts"))).otherwise(0).cast("int")
    return plain.select("range", part.alias("part"), "parts", "doc_id", "text", "row"), n_id, total


class Scan:
    """Words and window hashes of the documents of one chunk, and the order of the windows' values."""

    def __init__(self, text: pa.ChunkedArray, width: int, buckets: int):
        self.data, self.offsets = ts.buffers(text)
        parts, place, word = [], 0, 0
        starts, ends, first = [], [], [np.zeros(1, np.int64)]
        for i, j in ts.slices(self.offsets):
            at = self.offsets[i]
            data, offsets = self.data[at : self.offsets[j]], self.offsets[i : j + 1] - at
            s, e, f = ts.words(data, offsets)
            hashes = ts.span_hashes(data, s, e)
            w, owner = ts.windows(f, width)
            value = ts.rolling(hashes, width)[w] if len(w) else np.zeros(0, np.uint64)
            other = ts.rolling(hashes, width, SECOND_BASE)[w] if len(w) else np.zeros(0, np.uint64)
            bucket = (other >> np.uint64(32)) % np.uint64(buckets)
            parts.append((w + word, owner + place, value, bucket))
            starts.append(s + at)
            ends.append(e + at)
            first.append(f[1:] + word)
            place, word = place + j - i, word + len(s)
        cat = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.at, self.owner, self.value, bucket = cat(0, np.int64), cat(1, np.int64), cat(2, np.uint64), cat(3, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.first = np.concatenate(first)
        # one sort by (bucket, value): the bucket above the high bits of the value, which tell all but a few values
        bits = np.uint64((buckets - 1).bit_length())
        key = (bucket << (np.uint64(64) - bits)) | (self.value >> bits)
        order = np.argsort(key)
        value, key = self.value[order], key[order]
        if ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
            order = np.lexsort((self.value, bucket))
            value = self.value[order]
        bucket = bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])
        self.order, self.heads, self.values = order, np.flatnonzero(new), value[new]
        self.group = np.cumsum(new) - 1
        # the buckets that the chunk has values for, and where theirs begin
        self.buckets, begin = np.unique(bucket[new], return_index=True)
        self.cuts = np.append(begin, len(self.values))

    def least(self, ids: np.ndarray) -> np.ndarray:
        """The smallest of the documents' ids for each value."""
        mine = ids[self.owner[self.order]] if len(self.order) else np.zeros(0, np.int64)
        return np.minimum.reduceat(mine, self.heads) if len(mine) else mine


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)


def _send(width: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        scan = Scan(table["text"], width, buckets)
        cuts = list(zip(scan.cuts[:-1].tolist(), scan.cuts[1:].tolist(), strict=True))
        values = pa.array([scan.values[a:b].tobytes() for a, b in cuts], pa.binary())
        least = pa.nulls(len(cuts), pa.binary())
        if table.num_rows and table["parts"][0].as_py() > 1:  # other parts of the range have ids among those here
            ids = scan.least(_ids(table))
            least = pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary())
        place = [np.full(len(cuts), k.as_py(), np.int32) for k in key]
        return pa.table({"range": place[0], "part": place[1], "bucket": scan.buckets.astype(np.int64), "values": values, "least": least})

    return send


def _answer(n_id: int):
    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("range", "ascending"), ("part", "ascending")])
        where = table["range"].to_numpy()
        arrays = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["values"]]
        value = np.concatenate(arrays)
        sizes = np.array([len(a) for a in arrays])
        rank = np.repeat(where.astype(np.int64), sizes)
        least = np.zeros(len(value), np.int64)
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(table["least"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)).tolist():
            least[ends[k] - sizes[k] : ends[k]] = np.frombuffer(table["least"][k].as_buffer(), np.int64)
        least[rank == n_id] = LAST  # none of those without an id is earlier than another
        order = np.lexsort((least, rank, value)) if least.any() else np.argsort(value, kind="stable")  # ranges ascend already
        sorted_ = value[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        earlier = np.zeros(len(order), bool)
        r, i = rank[order], least[order]
        earlier[order] = (r[head] < r) | ((r[head] == r) & (i[head] < i))
        found = [(k, earlier[e - s : e]) for k, (s, e) in enumerate(zip(sizes, ends, strict=True))]
        found = [(k, np.packbits(x).tobytes()) for k, x in found if x.any()]
        at = pa.array([k for k, _ in found], pa.int64())
        return pa.table({"range": table["range"].take(at), "part": table["part"].take(at), "bucket": table["bucket"].take(at), "bits": pa.array([x for _, x in found], pa.binary())})

    return answer


def _spans(gone: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of removed words: start, end (word places of the chunk) and the text of each."""
    n = len(gone)
    edge = np.zeros(n + 1, bool)
    inner = first[(first > 0) & (first < n)]
    edge[inner] = True
    begin = gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1:n]
    stop = gone.copy()
    stop[:-1] &= ~gone[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(first, starts, "right") - 1


def _kept_text(scan: Scan, gone: np.ndarray, cut: bool) -> pa.Array:
    """The kept words of each text joined by one space, or (cut) the text without the removed stretches."""
    data, n = scan.data, len(scan.data)
    steps = np.zeros(n + 1, np.int32)
    if cut:  # from a removed word to the next word of the same text
        until = np.minimum(np.append(scan.starts[1:], n), scan.offsets[np.searchsorted(scan.offsets, scan.starts, "right")])
        steps += np.bincount(scan.starts[gone], minlength=n + 1).astype(np.int32)
        steps -= np.bincount(until[gone], minlength=n + 1).astype(np.int32)
        keep = np.cumsum(steps[:-1]) == 0
        out = data
    else:
        kept = np.flatnonzero(~gone)
        owner = np.searchsorted(scan.first, kept, "right") - 1
        ends = scan.ends[kept].copy()
        ends[:-1] += owner[1:] == owner[:-1]  # the byte after the word becomes the space
        steps += np.bincount(scan.starts[kept], minlength=n + 1).astype(np.int32)
        steps -= np.bincount(ends, minlength=n + 1).astype(np.int32)
        keep = np.cumsum(steps[:-1]) > 0
        out = np.where(ts.IS_SPACE[data], np.uint8(0x20), data)
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return pa.LargeStringArray.from_buffers(len(scan.offsets) - 1, pa.py_buffer(sums[scan.offsets].tobytes()), pa.py_buffer(out[keep].tobytes())).cast(pa.string())


def _remove(width: int, buckets: int, cut: bool):
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        scan = Scan(table["text"], width, buckets)
        earlier = np.zeros(len(scan.values), bool)
        for k, bits in zip(np.searchsorted(scan.buckets, replies["bucket"].to_numpy().astype(np.uint64)).tolist(), replies["bits"], strict=True):
            a, b = scan.cuts[k], scan.cuts[k + 1]
            earlier[a:b] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=b - a).astype(bool)
        ids = _ids(table)
        mine = ids[scan.owner[scan.order]] if len(scan.order) else np.zeros(0, np.int64)
        hit = earlier[scan.group] | (scan.least(ids)[scan.group] < mine)
        at = scan.at[scan.order[hit]]
        n = len(scan.starts)
        steps = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + width, minlength=n + 1)[: n + 1]
        gone = np.cumsum(steps[:n]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        starts, ends, owner = _spans(gone, scan.first)
        base = scan.first[owner]
        kept = _kept_text(scan, gone, cut)
        if cut:  # a null text stays null
            kept = pc.if_else(table["text"].combine_chunks().is_valid(), kept, None)
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["start", "end"]),
        )
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "row": ts.loosened(table["row"]),
                "n_words": np.diff(scan.first),
                "n_removed": total[scan.first[1:]] - total[scan.first[:-1]],
                "removed": spans.cast(span_type),
                "kept_text": kept,
            }
        )

    return remove


def remove_repeats(docs: DataFrame, width: int = WIDTH, cut: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """doc_id, row (the other columns), n_words, n_removed, removed (maximal word intervals), kept_text.

    A word goes when a window of ``width`` words covers it that also starts in a document with a smaller
    doc_id. ``kept_text`` has the kept words joined by one space; with ``cut``, the text as it was without
    the removed stretches, so that documents without repeats stay as they are.
    """
    chunks, n_id, total = in_chunks(docs, chunk_bytes, most_ranges)
    buckets = 1 << max(5, math.ceil(math.log2(max(1, total / 6 / bucket_windows))))
    # with all columns, so that both passes over the texts read one and the same shuffle
    sent = chunks.groupBy("range", "part").applyInArrow(_send(width, buckets), "range int, part int, bucket long, values binary, least binary")
    replies = sent.groupBy("bucket").applyInArrow(_answer(n_id), "range int, part int, bucket long, bits binary")
    row = chunks.schema["row"].dataType.simpleString()
    schema = f"doc_id long, row {row}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    return chunks.groupBy("range", "part").cogroup(replies.groupBy("range", "part")).applyInArrow(_remove(width, buckets, cut), schema)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated stretches cut out of their texts; n_chars follows the text where there is one."""
    out = remove_repeats(docs, width, cut=True)
    named = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    columns = [named[c].cast(docs.schema[c].dataType).alias(c) if c in named else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
