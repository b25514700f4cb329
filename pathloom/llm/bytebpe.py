"""Byte-level BPE encoding and decoding over Arrow batches, by the tokenizers library.

A text splits into pieces by the published pattern; the merges inside a piece depend on the piece alone. So
a batch is split with numpy, each distinct piece of it is encoded once by the library's BPE model, and the
ids of all pieces are gathered back in order. The character classes of the pattern are asked of the library
itself. Decoding turns each id back to its bytes by the reversed byte table; characters that two tokens
share come whole again because bytes are joined before they are read as UTF-8.

Defined results
* null text counts as empty and has no ids. Empty table: empty result.
* bytes that aren't UTF-8 are read as U+FFFD. Strings of special tokens in a text are ordinary text.
* repeated rows are encoded as often as they occur; other columns travel in the struct ``row``.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pieces that a worker remembers at most (about 40 bytes each), their ids, the bytes of those of LONG bytes or
#: more, and the pieces that wait for the long table.
REMEMBERED, REMEMBERED_IDS, REMEMBERED_BYTES, RECENT = 1 << 20, 1 << 22, 1 << 24, 1 << 15
LONG = 16
#: What may follow an apostrophe as a piece of its own.
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary file: ``.json`` of the tokenizers library or ``.tiktoken`` ranks."""

    path: str


@cache
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@cache
def character_classes() -> np.ndarray:
    """The class of every code point, by the library's own regular expressions.

    Only planes 0 to 3 hold letters, numbers or white space; the others are marks, private or not assigned.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.array([*range(0xD800), *range(0xE000, 0x40000)], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for piece, (i, j) in Split(Regex(pattern + "+"), "isolated").pre_tokenize_str(every):
            if _is(kind, piece[0]):
                table[points[i:j]] = kind
    return table


def _is(kind: int, character: str) -> bool:
    """Whether a run of one class begins with ``character``: runs of the class and the rest alternate."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    pattern = {LETTER: r"\p{L}", NUMBER: r"\p{N}", SPACE: r"\s"}[kind]
    return not Split(Regex(pattern), "removed").pre_tokenize_str(character)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bpe_model(path: str):
    """The library's BPE model of a vocabulary file: its merges, or those found again from the ranks."""
    from tokenizers.models import BPE

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return BPE(vocab=model["vocab"], merges=merges, ignore_merges=bool(model.get("ignore_merges")), cache_capacity=0)
    ranks, shown = _ranks(path), byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        parts = [(token[:k], token[k:]) for k in range(1, len(token))]
        parts = [(a, b) for a, b in parts if a in ranks and b in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(parts, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    return BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)


@cache
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in one array, and where those of each id begin in it."""
    if path.endswith(".json"):
        back = {c: b for b, c in enumerate(byte_characters())}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        raw = {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in vocab.items()}
    else:
        raw = {r: t for t, r in _ranks(path).items()}
    every = [raw.get(i, b"") for i in range(max(raw, default=-1) + 1)]
    return np.frombuffer(b"".join(every), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in every])]).astype(np.int64)


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of the texts in them."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ends = np.cumsum([0, *map(len, texts)])
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), ends
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offsets]


def utf8_of(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The bytes of the code points: ``data`` itself, unless it wasn't UTF-8."""
    if int(((data & 0xC0) != 0x80).sum()) == len(points) and not (points == 0xFFFD).any():
        return data
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)


def pieces(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the published pattern begin, in all texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = character_classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = change | first
    # the last white space before other characters is a piece of its own, or (U+0020) part of the next one
    after = np.flatnonzero(change[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    # an apostrophe that begins a piece takes a short form with it
    quote = np.flatnonzero((points == 0x27) & start)
    for form in SHORT_FORMS:
        size = len(form)
        at = quote[quote + size < n]
        for k, c in enumerate(form):
            at = at[(points[at + 1 + k] == ord(c)) & ~first[at + 1 + k]]
        start[at + 1] = False
        end = at + 1 + size
        start[end[end < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of batches of texts; remembers the ids of pieces that it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.model = bpe_model(vocabulary.path)
        self.shown = dict(enumerate(byte_characters()))
        self._forget()

    def _forget(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16)
        self.count = 0
        self.long: dict[bytes, int] = {}  # the long pieces, numbered
        self.long_bytes = 0
        none = np.zeros(0, np.uint64)
        # (first key, second key, number) of the known pieces by first key: a long table and a recent one
        self.tables = [(none, none, np.zeros(0, np.int32))] * 2

    def _keys(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two keys of 64 bits, equal for equal pieces only: the bytes and the length of a piece, or its number if it is long."""
        blocks, size = ts.eight_bytes(raw), ends - starts
        one = blocks[starts] & ts.FIRST_BYTES[np.minimum(size, 8)]
        two = blocks[np.minimum(starts + 8, len(raw))] & ts.FIRST_BYTES[np.clip(size - 8, 0, 7)]
        two |= np.minimum(size, LONG).astype(np.uint64) << np.uint64(56)
        at = np.flatnonzero(size >= LONG)
        if len(at):
            number = np.empty(len(at), np.uint64)
            for k, (a, b) in enumerate(zip(starts[at].tolist(), ends[at].tolist(), strict=True)):
                piece = raw[a:b].tobytes()
                seen = self.long.get(piece)
                if seen is None:
                    seen = self.long[piece] = len(self.long)
                    self.long_bytes += b - a
                number[k] = seen
            one[at], two[at] = number, np.uint64(LONG << 56)
        return ts.mix(one ^ ts.mix(two)), two  # the first key spreads the pieces; with the second it still tells the bytes

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Numbers of pieces that were not known."""
        tokenize, shown = self.model.tokenize, self.shown
        found = [[t.id for t in tokenize(w.decode("latin-1").translate(shown))] for w in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        a, b = self.count, self.used
        while len(self.begin) < a + len(new):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        if len(sizes) and int(sizes.max()) > np.iinfo(self.size.dtype).max:
            self.size = self.size.astype(np.int32)
        while len(self.flat) < b + len(ids):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[b : b + len(ids)] = ids
        self.begin[a : a + len(new)] = b + np.cumsum(sizes) - sizes
        self.size[a : a + len(new)] = sizes
        self.count, self.used = a + len(new), b + len(ids)
        return np.arange(a, self.count, dtype=np.int32)

    def _numbers(self, one: np.ndarray, two: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each distinct piece: known by its two keys, or learned from the text."""
        out = np.full(len(one), -1, np.int32)
        for first, second, number in self.tables:
            if len(first):
                at = np.minimum(np.searchsorted(first, one), len(first) - 1)
                hit = (first[at] == one) & (second[at] == two)
                out[hit] = number[at[hit]]
        new = np.flatnonzero(out < 0)
        out[new] = self._learn([raw[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        self.tables[1] = self._merged(self.tables[1], (one[new], two[new], out[new]))
        if len(self.tables[1][0]) > RECENT:
            self.tables = [self._merged(*self.tables), (one[:0], two[:0], out[:0])]
        return out

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0])
        return tuple(x[order] for x in both)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the offsets of the texts in them."""
        points, at = points_of(data, offsets)
        starts = pieces(points, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.count > REMEMBERED or self.used > REMEMBERED_IDS or self.long_bytes > REMEMBERED_BYTES:
            self._forget()
        raw = utf8_of(data, points)
        first = np.flatnonzero((raw & 0xC0) != 0x80)[starts]
        ends = np.append(first[1:], len(raw))
        one, two = self._keys(raw, first, ends)
        order = np.argsort(one)
        new = np.ones(len(order), bool)
        new[1:] = one[order][1:] != one[order][:-1]
        if (two[order] != two[order[np.flatnonzero(new)]][np.cumsum(new) - 1]).any():  # two pieces with one first key
            order = np.lexsort((two, one))
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        heads = order[new]
        index = self._numbers(one[heads], two[heads], raw, first[heads], ends[heads])
        word = np.empty(len(order), np.int32)
        word[order] = index[np.cumsum(new) - 1]
        size = self.size[word].astype(np.int64)
        total = np.zeros(len(word) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        where = np.repeat(self.begin[word] - total[:-1], size) + np.arange(total[-1])
        return self.flat[where], total[np.searchsorted(starts, at)]


@cache
def encoder(vocabulary: Vocabulary) -> Encoder:
    """One for each worker process."""
    return Encoder(vocabulary)


def decoded(vocabulary: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, and the n + 1 byte offsets of the ids in them."""
    flat, begin = byte_table(vocabulary.path)
    size = begin[ids + 1] - begin[ids] if len(ids) else np.zeros(0, np.int64)
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    where = np.repeat(begin[ids] - total[:-1], size) + np.arange(total[-1]) if len(ids) else np.zeros(0, np.int64)
    return flat[where], total


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one buffer and byte offsets."""
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return column.cast(pa.binary())


def others(docs: DataFrame):
    """The columns beside doc_id and text as one struct, so that names cannot clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("string").alias("none"))


def encode(docs: DataFrame, vocabulary: Vocabulary, spans: bool = False) -> DataFrame:
    """doc_id, row, ids (little-endian unsigned 32-bit), with ``spans`` also byte_starts and char_starts.

    byte_starts and char_starts have a place more than ids: token k covers bytes byte_starts[k] to
    byte_starts[k + 1]; char_starts counts the characters that begin before the token, so tokens that share
    a character begin at the same one or the next.
    """
    shared.arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = encoder(vocabulary)
        for rows, data, offsets in ts.texts(batches):
            ids, at = get(data, offsets)
            columns = [rows.column("doc_id"), ts.loosened(rows.column("row")), binaries(ids.view(np.uint8), at * 4)]
            names = ["doc_id", "row", "ids"]
            if spans:
                raw, begin = decoded(vocabulary, ids.astype(np.int64))
                lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                for name, places in (("byte_starts", begin), ("char_starts", lead[begin])):
                    owner = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)
                    where = np.arange(len(owner)) - owner
                    list_at = pa.array(at + np.arange(len(at)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(list_at, pa.array(places[where] - places[at[:-1]][owner], pa.int64())))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select("doc_id", "text", others(docs).alias("row"))
    kind = lambda c: plain.schema[c].dataType.simpleString()
    schema = f"doc_id {kind('doc_id')}, row {kind('row')}, ids binary"
    return plain.mapInArrow(run, schema + (", byte_starts array<bigint>, char_starts array<bigint>" if spans else ""))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the bytes of their ids. A null ``ids`` gives no bytes."""
    shared.arrow_rows(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ts.texts(batches, "ids"):
            ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            raw, begin = decoded(vocabulary, ids)
            yield pa.RecordBatch.from_arrays([*rows.columns, binaries(raw, begin[offsets // 4])], [*rows.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def installed(name: str) -> Vocabulary:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return Vocabulary(os.path.abspath(public_tokenizers.path(name)))
