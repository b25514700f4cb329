"""Line dedup: a line that several documents share stays only in the one with the largest doc_id.

A line's key is the line without white space at its ends and with A-Z in lower case; its 128-bit hash stands for
it. Half of the hash names a shard and gives a fingerprint, the other half is the key of the shard's minimal
perfect hash. A shard is a file in the shared folder: the perfect hash of its distinct keys and, in each slot, a
32-bit fingerprint, the number of documents with the line and the largest doc_id among them. Documents aren't
joined with lines: a chunk of documents sends each shard the distinct hashes that it has for it as one message,
the shard's arrays are probed, and what comes back are the hashes of lines that go, with the id that keeps them.

A line that all documents have is counted once per document inside a batch, then by partial sums, and is asked
for once per chunk, so no task grows with its copies. A shard holds about SHARD_KEYS distinct keys at any size of
the table. Two lines count as equal when 64 bits, the shard and the fingerprint of an independent 64 agree. A
line that was never indexed is found wrongly with a probability of 2 ** -32.

Defined results
* null or empty text: one empty line, which stays. Empty table: empty result.
* a key counts once per row, rows that share a doc_id are documents of their own; all rows of the largest doc_id
  keep the line.
* a null doc_id is smaller than any; a line that only rows without an id have stays in all of them.
* a text whose lines all go becomes empty. Columns beside doc_id and text travel in the struct column ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts
from pathloom.llm.bytebpe import others
from pathloom.llm.id_files import PerfectHash, opened, stored

#: Code points that a key has at least, and documents with it at least, for its lines to go.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bytes of text of a chunk, and distinct keys of a shard at most (a key and its newline take LEAST_CHARS + 1 bytes).
CHUNK_BYTES, SHARD_KEYS = 4 << 20, 1 << 20
#: Fixed values of the file format: eight words of 64 bits, the first of them this.
MAGIC, HEADER = 0x31_58_44_4E_4C_54_50_4C, 8


class Lines:
    """The lines of some texts: where each begins and ends, and the digests of the keys that are long enough."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least_chars: int):
        self.data, self.n = data, len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        owner = np.searchsorted(offsets, breaks, "right") - 1
        self.counts = np.bincount(owner, minlength=self.n) + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.starts, self.ends = np.empty(self.first[-1], np.int64), np.empty(self.first[-1], np.int64)
        k = np.arange(len(breaks)) + owner
        self.starts[self.first[:-1]], self.starts[k + 1] = offsets[:-1], breaks + 1
        self.ends[self.first[1:] - 1], self.ends[k] = offsets[1:], breaks
        self.owner = np.repeat(np.arange(self.n), self.counts)
        # a key runs from the first word of its line to the last
        words, until, _ = ts.words(data, offsets)
        a, b = np.searchsorted(words, self.starts), np.searchsorted(until, self.ends, "right")
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.long, begin, end = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(words):
            some = np.flatnonzero(a < b)
            begin, end = words[a[some]], until[b[some] - 1]
            enough = chars[end] - chars[begin] >= least_chars
            self.long, begin, end = some[enough], begin[enough], end[enough]
        low = memoryview(ts.LOWER[data].tobytes())
        self.digests = [xxhash.xxh3_128_digest(low[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]


def _halves(digests: list[bytes]) -> np.ndarray:
    """Two columns: the key of the perfect hash, and the half that names the shard and the fingerprint."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _shard(second: np.ndarray, shards: int) -> np.ndarray:
    return ((second >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


class Shard:
    """The arrays of one shard."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        with files.open_input_file(path) as f:
            raw = f.read()
        head = np.frombuffer(raw, "<i8", HEADER)
        if int(head[0]) != MAGIC:
            raise ValueError(f"{uri} is not a shard of lines")
        levels, words, n = (int(x) for x in head[1:4])
        at = 8 * HEADER
        self.hash = PerfectHash(np.frombuffer(raw, "<i8", levels, at), np.frombuffer(raw, "<u8", words, at + 8 * levels))
        at += 8 * (levels + words)
        self.last = np.frombuffer(raw, "<i8", n, at)
        self.prints, self.counts = np.frombuffer(raw, "<u4", n, at + 8 * n), np.frombuffer(raw, "<u4", n, at + 12 * n)
        self.known = np.frombuffer(raw, np.uint8, n, at + 16 * n).astype(bool)

    def find(self, halves: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the shard hasn't got it."""
        out = self.hash.slots(halves[:, 0])
        known = np.flatnonzero(out >= 0)
        out[known[self.prints[out[known]] != halves[known, 1].astype(np.uint32)]] = -1
        return out

    @staticmethod
    def write(uri: str, halves: np.ndarray, counts: np.ndarray, last: np.ndarray, known: np.ndarray) -> None:
        found = PerfectHash.build(halves[:, 0])
        slots, n = found.slots(halves[:, 0]), len(halves)
        header = np.zeros(HEADER, "<i8")
        header[:4] = MAGIC, len(found.sizes), len(found.words), n
        placed = [(last, "<i8"), (halves[:, 1].astype(np.uint32), "<u4"), (np.minimum(counts, (1 << 32) - 1), "<u4"), (known, np.uint8)]
        with stored(uri) as out:
            for part in (header, found.sizes.astype("<i8"), found.words.astype("<u8")):
                out.write(part.tobytes())
            for values, kind in placed:
                column = np.zeros(n, kind)
                column[slots] = values
                out.write(column.tobytes())


class LineIndex:
    """Shards of all distinct lines of ``docs`` in a folder of their own."""

    def __init__(self, folder: str, shards: int, least_chars: int = LEAST_CHARS):
        self.folder, self.shards, self.least_chars = folder, shards, least_chars

    def uri(self, shard: int) -> str:
        return f"{self.folder}/lines-{shard:08d}"

    @classmethod
    def build(cls, docs: DataFrame, folder: str, least_chars: int = LEAST_CHARS, shard_keys: int = SHARD_KEYS, total: int | None = None) -> LineIndex:
        total = text_bytes(docs) if total is None else total
        index = cls(folder, max(1, math.ceil(total / (least_chars + 1) / shard_keys)), least_chars)
        shared.arrow_rows(docs.sparkSession)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in ts.texts(batches):
                lines = Lines(data, offsets, least_chars)
                ids = rows.column("doc_id").to_pylist()
                found: dict[bytes, list] = {}
                for key, owner in zip(lines.digests, lines.owner[lines.long].tolist(), strict=True):
                    seen = found.setdefault(key, [0, None, -1])  # documents, largest id, last row
                    if seen[2] != owner:
                        own = ids[owner]
                        seen[0] += 1
                        seen[1] = own if seen[1] is None or (own is not None and own > seen[1]) else seen[1]
                        seen[2] = owner
                halves = _halves(list(found))
                yield pa.RecordBatch.from_pydict({
                    "first": halves[:, 0].view(np.int64), "second": halves[:, 1].view(np.int64),
                    "n": pa.array([v[0] for v in found.values()], pa.int64()), "last": pa.array([v[1] for v in found.values()], pa.int64()),
                })

        counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "first long, second long, n long, last long")
        keys = counted.groupBy("first", "second").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        shard = F.shiftrightunsigned("second", 32) % index.shards

        def store(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            halves = np.stack([table[c].to_numpy().view(np.uint64) for c in ("first", "second")], 1)
            last = table["last"].combine_chunks()
            Shard.write(index.uri(key[0].as_py()), halves, table["n"].to_numpy(), last.fill_null(0).to_numpy(), last.is_valid().to_numpy(zero_copy_only=False))
            return pa.table({"shard": [key[0].as_py()], "n_keys": [table.num_rows]})

        shared.settle(keys.withColumn("shard", shard).groupBy("shard").applyInArrow(store, "shard long, n_keys long"), "line-shards")
        return index

    def probed(self, asked: DataFrame, least_docs: int) -> DataFrame:
        """Messages (shard, chunk, keys) to answers (chunk, keys, last, known): the keys of lines that repeat."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, shard = -1, None
            for batch in batches:
                out: dict[str, list] = {"chunk": [], "keys": [], "last": [], "known": []}
                for k, chunk, keys in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "keys")), strict=True):
                    if k != at:
                        at, shard = k, Shard(self.uri(k))  # messages come shard by shard
                    halves = np.frombuffer(keys, "<u8").reshape(-1, 2)
                    slots = shard.find(halves)
                    goes = np.flatnonzero(slots >= 0)
                    goes = goes[shard.counts[slots[goes]] >= least_docs]
                    if len(goes):
                        for name, value in (("chunk", chunk), ("keys", halves[goes].tobytes()), ("last", shard.last[slots[goes]].tobytes()), ("known", shard.known[slots[goes]].tobytes())):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["chunk"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("keys", "last", "known"))], list(out))

        return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "chunk long, keys binary, last binary, known binary")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _ask(index: LineIndex):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data, offsets = ts.buffers(table["text"])
        keys: set[bytes] = set()
        for i, j in ts.slices(offsets):
            keys.update(Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], index.least_chars).digests)
        halves = _halves(list(keys))
        shard = _shard(halves[:, 1], index.shards)
        order = np.argsort(shard, kind="stable")
        names, cuts = np.unique(shard[order], return_index=True)
        parts = [x.tobytes() for x in np.split(halves[order], cuts[1:])] if len(names) else []
        return pa.table({"shard": names.astype(np.int64), "chunk": np.full(len(names), key[0].as_py(), np.int64), "keys": pa.array(parts, pa.binary())})

    return ask


def _drop(index: LineIndex, keep_null: bool):
    def drop(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        keeper: dict[bytes, int | None] = {}
        for keys, last, known in zip(*(answers[c].to_pylist() for c in ("keys", "last", "known")), strict=True):
            ids = zip(np.frombuffer(last, "<i8").tolist(), known, strict=True)
            keeper.update((keys[16 * k : 16 * k + 16], x if there else None) for k, (x, there) in enumerate(ids))
        data, offsets = ts.buffers(table["text"])
        ids, texts, n_lines, n_dropped = table["doc_id"].to_pylist(), [], [], []
        for i, j in ts.slices(offsets):
            lines = Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], index.least_chars)
            stays = np.ones(len(lines.starts), bool)
            for line, digest, owner in zip(lines.long.tolist(), lines.digests, lines.owner[lines.long].tolist(), strict=True):
                if digest in keeper and keeper[digest] != ids[i + owner]:
                    stays[line] = False
            texts.append(_joined(lines, stays))
            n_lines.append(lines.counts)
            n_dropped.append(lines.counts - np.bincount(lines.owner[stays], minlength=lines.n))
        cat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        kept = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
        if keep_null:
            kept = pc.if_else(table["text"].combine_chunks().is_valid(), kept, None)
        return pa.table({"doc_id": table["doc_id"], "row": ts.loosened(table["row"]), "n_lines": cat(n_lines), "n_dropped": cat(n_dropped), "kept_text": kept})

    return drop


def _joined(lines: Lines, stays: np.ndarray) -> pa.Array:
    """The lines that stay, joined by newlines: each with the newline after it, but for the last one of its text."""
    n, kept = len(lines.data), np.flatnonzero(stays)
    until = lines.ends[kept].copy()
    until[:-1] += lines.owner[kept[1:]] == lines.owner[kept[:-1]]
    steps = np.bincount(lines.starts[kept], minlength=n + 1) - np.bincount(until, minlength=n + 1)
    keep = np.cumsum(steps[:n]) > 0
    sums = np.concatenate([[0], np.cumsum(keep)])
    bounds = sums[np.append(lines.starts[lines.first[:-1]], n)]
    return pa.LargeStringArray.from_buffers(lines.n, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(lines.data[keep].tobytes())).cast(pa.string())


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, chunk_bytes: int = CHUNK_BYTES, shard_keys: int = SHARD_KEYS, folder: str | None = None, keep_null: bool = False) -> DataFrame:
    """doc_id, row (the other columns), n_lines (before), n_dropped, kept_text (null for a null text with ``keep_null``).

    The index stays in ``folder`` (a new one in the shared folder by default).
    """
    total = text_bytes(docs)
    index = LineIndex.build(docs, folder or shared.scratch(docs.sparkSession, "lines"), least_chars, shard_keys, total)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(total / chunk_bytes))))
    chunks = docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text", others(docs).alias("row"))
    # with all columns, so that both passes over the chunks read one and the same shuffle
    asked = chunks.groupBy("chunk").applyInArrow(_ask(index), "shard long, chunk long, keys binary")
    answers = index.probed(asked, least_docs)
    row = chunks.schema["row"].dataType.simpleString()
    schema = f"doc_id long, row {row}, n_lines long, n_dropped long, kept_text string"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_drop(index, keep_null), schema)


def without_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the repeated lines cut out of their texts; n_chars follows the text where there is one."""
    out = drop_lines(docs, least_chars, least_docs, keep_null=True)
    named = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return out.select(*[named[c].cast(docs.schema[c].dataType).alias(c) if c in named else F.col("row")[c].alias(c) for c in docs.columns])
