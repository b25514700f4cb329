"""Packing by power-of-two decomposition: every document splits into pieces of binary lengths.

A document of n ids gives n // longest pieces of the longest length and one piece for each one bit of the
rest, from large to small. Each piece is a sequence of its own and its length is a power of two, so there is
no padding and no sequence crosses documents; sequences of one length form a bucket, from which a training
batch is drawn. sequence_id counts all sequences without gaps, the longest bucket first.

Numbers are given in two steps, so no task sees all sequences: the task that cuts the pieces counts them by
length, and the counts of tasks before it (a row for each task and length) are added after the pieces have
been written. A lost executor thus never changes a number that has been given.

Defined results
* null text counts as empty; an empty text is the end id alone, one piece of length 1. Empty table: empty.
* repeated rows are packed as often as they occur. Other columns travel in the struct ``row``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts
from pathloom.llm.bytebpe import Vocabulary, binaries, encoder, others

LONGEST = 2048


def decomposition(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all pieces of documents of these sizes, in order."""
    bits = longest.bit_length() - 1
    whole, rest = sizes >> bits, sizes & (longest - 1)
    powers = 1 << np.arange(bits - 1, -1, -1)
    has = (rest[:, None] & powers[None, :]) > 0
    counts = np.concatenate([whole[:, None], has], axis=1)
    lengths = np.concatenate([[longest], powers])
    length = np.repeat(np.tile(lengths, len(sizes)), counts.ravel())
    owner = np.repeat(np.arange(len(sizes)), counts.sum(axis=1))
    ends = np.cumsum(length)
    base = np.concatenate([[0], np.cumsum(sizes)])
    return owner, ends - length - base[owner], length


def pack(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 1, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, row and (with_ids) ids.

    ``longest`` must be a power of two. ids are little-endian unsigned 32-bit.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    shared.arrow_rows(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(longest.bit_length(), np.int64)
        for rows, data, offsets in ts.texts(batches):
            ids, at = get(data, offsets)
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            sizes = np.diff(at)
            owner, start, length = decomposition(sizes, longest)
            level = np.log2(length).astype(np.int64)
            nth = np.zeros(len(level), np.int64)
            for k in np.unique(level):
                mine = level == k
                count = int(mine.sum())
                nth[mine] = seen[k] + np.arange(count)
                seen[k] += count
            begin = np.append(at[owner] + start, len(ids))
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            pick = pa.array(owner)
            columns = [rows.column("doc_id").take(pick), ts.loosened(rows.column("row")).take(pick), pa.array(start), pa.array(length), pa.array(sizes[owner]), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), task)), pa.array(nth)]
            names = ["doc_id", "row", "start", "length", "doc_tokens", "ids_crc32", "task", "nth"]
            if with_ids:
                columns, names = [*columns, binaries(ids.view(np.uint8), begin * 4)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select("doc_id", "text", others(docs).alias("row"))
    kind = lambda c: plain.schema[c].dataType.simpleString()
    schema = f"doc_id {kind('doc_id')}, row {kind('row')}, start long, length long, doc_tokens long, ids_crc32 long, task long, nth long"
    pieces = shared.settle(plain.mapInArrow(cut, schema + (", ids binary" if with_ids else "")), "pieces")
    counts = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))
    longer = Window.partitionBy(F.lit(0)).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", F.coalesce(F.sum("total").over(longer), F.lit(0)).alias("base"))  # a row per power of two
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(F.broadcast(bases), "length")
    out = pieces.join(first, ["length", "task"])
    named = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("before") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "row"]
    return out.select(*named, *(["ids"] if with_ids else []))
