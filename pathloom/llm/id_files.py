"""Token-id files with keyed access: raw id payloads, found by a minimal perfect hash of the document key.

The ids of all documents lie in ascending order of doc_id, shard after shard. A shard is two files:

``shard-N.ids``    the payload (unsigned 16- or 32-bit little-endian ids, nothing between documents), then
                   the offsets of the documents in it (n + 1 of 64 bits) and their keys (n of 64 bits).
``shard-N.index``  the minimal perfect hash of the distinct keys, and in each of its slots a 32-bit
                   fingerprint of the key and the place of its first document.

The first ends and the second begins with a fixed header. Texts are sorted into shards and encoded as their
payload is written, piece by piece, so a task holds no more of its shard than the sizes and keys. The hash has levels of bits: a key is at the first level where it alone hits
its bit, and its slot is the number of bits set before that one, so a look-up reads a constant number of
words. A key that was never stored is told by its fingerprint (wrongly found with probability 2 ** -32,
then ruled out by the stored key). Files are written under another name and renamed, so a repeated task
leaves one whole file; they go to the shared folder by pyarrow's file systems.

Defined results
* null text counts as empty: the end id alone. Empty table: no shard with rows, empty result.
* rows that share a doc_id are stored one after another, in order of a hash of the text, over as many shards as their
  bytes need; a look-up gives all of them. Only rows with one doc_id and one text are always in one shard.
* a null doc_id comes before all others and is stored without an index entry; reading in order gives it.
* columns beside doc_id and text are not stored.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts
from pathloom.llm.bytebpe import Vocabulary, binaries, encoder

#: Bytes of text of a shard.
SHARD_BYTES = 16 << 20
#: Fixed values of the file format: eight words of 64 bits, the first of them this.
MAGIC, HEADER = 0x31_53_44_49_4D_4C_54_50, 8
LEVEL_SEED, PRINT_SEED = 0x632BE59BD9B4E019, 0xE7037ED1A0B428DB  # fixed values: seeds of the key hashes


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (ts.mix(keys ^ np.uint64((LEVEL_SEED * (level + 1)) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (ts.mix(keys ^ np.uint64(PRINT_SEED)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = keys.astype(np.uint64), [], []
        while len(left):
            size = -(-max(len(left) * 5 // 4, 64) // 64) * 64
            at = _level(left, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            bits.append(hits == 1)
            sizes.append(size)
            left = left[hits[at] > 1]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little").view("<u8").astype(np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that were not stored."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            bit = _level(keys[left], level, size) + self.begin[level]
            word, place = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.words[word] >> place) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << place) - np.uint64(1))
            out[left[here]] = (self.before[word] + np.bitwise_count(below))[here]
            left = left[~here]
            if not len(left):
                break
        return out


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def stored(uri: str) -> Iterator[pa.NativeFile]:
    """A stream that becomes the file ``uri`` when it is closed; a repeated task leaves one whole file."""
    files, path = opened(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    context = TaskContext.get()
    partial = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with files.open_output_stream(partial) as out:
        yield out
    files.move(partial, path)


class ShardReader:
    """Reads one shard: a key's documents in constant time, or all documents in order."""

    def __init__(self, uri: str):
        files, path = opened(uri)
        self.file = files.open_input_file(path + ".ids")
        head = np.frombuffer(self.file.read_at(8 * HEADER, self.file.size() - 8 * HEADER), "<i8")
        if int(head[0]) != MAGIC:
            raise ValueError(f"{uri} is not a shard of ids")
        self.width, self.n, self.total, self.nulls = (int(x) for x in head[1:5])
        self.tail = self.total * self.width + -(self.total * self.width) % 8
        with files.open_input_file(path + ".index") as f:
            raw = f.read()
        head = np.frombuffer(raw, "<i8", HEADER)
        levels, words, slots = (int(x) for x in head[1:4])
        at = 8 * HEADER
        sizes = np.frombuffer(raw, "<i8", levels, at)
        bits = np.frombuffer(raw, "<u8", words, at + 8 * levels)
        at += 8 * (levels + words)
        self.hash = PerfectHash(sizes, bits)
        self.first = np.frombuffer(raw, "<i8", slots, at)
        self.prints = np.frombuffer(raw, "<u4", slots, at + 8 * slots)

    def _at(self, place: int, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * count, self.tail + 8 * place), "<i8")

    def keys(self) -> np.ndarray:
        """All keys in order; the first ``nulls`` of them stand for null."""
        return self._at(self.n + 1, self.n)

    def offsets(self) -> np.ndarray:
        return self._at(0, self.n + 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of the first document of each key, -1 where the shard has none."""
        slots = self.hash.slots(keys)
        out = np.full(len(keys), -1, np.int64)
        known = np.flatnonzero(slots >= 0)
        same = self.prints[slots[known]] == fingerprints(keys[known].astype(np.uint64))
        out[known[same]] = self.first[slots[known[same]]]
        return out

    def places(self) -> np.ndarray:
        """The place of each document by the index: that of its key's first document and its number among those of the key."""
        named = self.keys()[self.nulls :]
        new = np.ones(len(named), bool)
        new[1:] = named[1:] != named[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(named)), 0))
        first = self.find(named)
        out = first + np.arange(len(named)) - begin
        if (first < 0).any() or (out >= self.n).any() or (self.keys()[out] != named).any():
            raise ValueError("the index doesn't give the keys of its shard")
        return np.concatenate([np.arange(self.nulls), out])

    def read(self, begin: int, end: int) -> np.ndarray:
        """The ids from place ``begin`` to ``end`` of the payload, as little-endian unsigned 32-bit."""
        raw = self.file.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of all documents of ``key``, without reading any other."""
        place = int(self.find(np.array([key], np.int64))[0])
        out: list[np.ndarray] = []
        while 0 <= place < self.n and int(self._at(self.n + 1 + place, 1)[0]) == key and place >= self.nulls:
            begin, end = (int(x) for x in self._at(place, 2))
            out.append(self.read(begin, end))
            place += 1
        return out


def write(docs: DataFrame, vocabulary: Vocabulary, folder: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES, width: int = 2) -> DataFrame:
    """Write all documents to ``folder``; returns its manifest, a row per shard: shard, uri, n_docs, n_ids, first_key, last_key, start.

    ``width`` is the bytes of an id (2 or 4). Documents go to shards of about ``shard_bytes`` by ranges of doc_id.
    """
    spark = docs.sparkSession
    shared.arrow_rows(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, shard = encoder(vocabulary), TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}"
        keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        nulls = n_bytes = 0
        with stored(uri + ".ids") as out:
            for rows, data, offsets in ts.texts(batches):
                ids, at = get(data, offsets)
                ids = np.insert(ids, at[1:], end_id)
                if int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                out.write(ids.astype(f"<u{width}"))
                column = rows.column("doc_id")
                nulls += column.null_count
                keys.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                sizes.append(np.diff(at) + 1)
                n_bytes += len(ids) * width
            key = np.concatenate(keys)
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            header = np.zeros(HEADER, "<i8")
            header[:5] = MAGIC, width, len(key), n_bytes // width, nulls
            for part in (bytes(-n_bytes % 8), at.astype("<i8").tobytes(), key.astype("<i8").tobytes(), header.tobytes()):
                out.write(part)
        distinct, place = np.unique(key[nulls:], return_index=True)
        found = PerfectHash.build(distinct)
        slots = found.slots(distinct)
        begin, prints = np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<u4")
        begin[slots], prints[slots] = place + nulls, fingerprints(distinct.astype(np.uint64))
        header = np.zeros(HEADER, "<i8")
        header[:4] = MAGIC, len(found.sizes), len(found.words), len(distinct)
        with stored(uri + ".index") as out:
            for part in (header, found.sizes.astype("<i8"), found.words.astype("<u8"), begin, prints):
                out.write(part.tobytes())
        if len(key):
            least, most = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [len(key)], "n_ids": [n_bytes // width], "first_key": pa.array([least], pa.int64()), "last_key": pa.array([most], pa.int64())})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spread = F.xxhash64("text")  # rows with one key needn't be in one shard
    ranged = plain.withColumn("_s", spread).repartitionByRange(int(max(1, -(-total // shard_bytes))), "doc_id", "_s").sortWithinPartitions("doc_id", "_s", "text")
    manifest = shared.settle(ranged.select("doc_id", "text").mapInArrow(run, "shard long, uri string, n_docs long, n_ids long, first_key long, last_key long"), "manifest")
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, by_key: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, from the files.

    ``by_key``: the place of every document comes from the index of its shard, by its key and, where several rows share
    it, its number among them; a key that the index doesn't give is an error. Else documents are read in their order.
    """
    shared.arrow_rows(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["uri"])
                keys, at = shard.keys(), shard.offsets()
                place = shard.places() if by_key else np.arange(shard.n)
                size = at[place + 1] - at[place]
                for i, j in ts.slices(np.concatenate([[0], np.cumsum(size * 4)])):
                    part = place[i:j]
                    if (np.diff(part) == 1).all():
                        ids = shard.read(int(at[part[0]]), int(at[part[-1] + 1]))
                    else:
                        ids = np.concatenate([shard.read(int(at[p]), int(at[p + 1])) for p in part.tolist()])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(keys[part], mask=part < shard.nulls),
                            "start": pa.array(at[part] + row["start"]),
                            "n_tokens": pa.array(size[i:j]),
                            "ids": binaries(ids.view(np.uint8), np.concatenate([[0], np.cumsum(size[i:j])]) * 4),
                        }
                    )

    # a number of its own, so that the few rows of the manifest aren't gathered in one task
    dealt = manifest.select("shard", "uri", "start").repartition(max(1, manifest.count()), "shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and ids of every document with one of the given keys (column doc_id), by the shards' indexes.

    A key goes to the shards between whose first and last key it lies; keys that no shard has give no row.
    """
    shared.arrow_rows(manifest.sparkSession)
    shards = sorted((r["first_key"], r["last_key"], r["shard"]) for r in manifest.select("first_key", "last_key", "shard").collect() if r["first_key"] is not None)  # a row per shard
    if not shards:
        return keys.select(F.col("doc_id").cast("long"), F.lit(None).cast("binary").alias("ids")).limit(0)
    sent = manifest.sparkSession.sparkContext.broadcast(np.array(shards, np.int64))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, names = sent.value.T
        for batch in batches:
            key = batch.column("doc_id").to_numpy(zero_copy_only=False)
            # shards are in order, so those that may have a key lie side by side
            begin, end = np.searchsorted(last, key, "left"), np.searchsorted(first, key, "right")
            count = np.maximum(end - begin, 0)
            owner = np.repeat(np.arange(len(key)), count)
            slot = np.arange(len(owner)) - (np.cumsum(count) - count)[owner] + begin[owner]
            yield pa.RecordBatch.from_arrays([pa.array(key[owner]), pa.array(names[slot])], ["doc_id", "shard"])

    plain = keys.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    routed = plain.mapInArrow(route, "doc_id long, shard long").join(manifest.select("shard", "uri"), "shard").select("doc_id", "shard", "uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: dict[str, ShardReader] = {}
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for row in batch.to_pylist():
                if row["uri"] not in open_shards:
                    open_shards = {row["uri"]: ShardReader(row["uri"])}  # rows come shard by shard
                for ids in open_shards[row["uri"]].get(row["doc_id"]):
                    out[0].append(row["doc_id"])
                    out[1].append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["doc_id", "ids"])

    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, ids binary")
