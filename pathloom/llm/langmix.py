"""Language ID by mixture inference: which languages a document is made of, and in which proportions.

Training counts letter trigrams (with word ends) of all documents of known language into a table of fixed
size per language; the counts of a task are summed before they are shuffled. In a document every word has a
likelihood under each language, the product over its trigrams; expectation-maximisation estimates the
proportions of the languages that best explain its words. The set of languages is the one with the best
penalised likelihood (half the logarithm of the number of words for each further language), searched over
the sets of the most likely 1, 2, ... languages: all sizes up to ALWAYS_FITTED, and on from there while a
larger set was better or its last language has LEAST_MIXED words of the document or more.

Defined results
* text null or without letters: language ``und``, score 0, no mixture. So are all texts when nothing was
  learned. Empty table: empty result.
* training rows with null text or language add nothing; repeated rows count as often as they occur.
* a tie goes to the language that sorts first. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import shared
from pathloom.llm import textscan as ts
from pathloom.llm.bytebpe import LETTER, character_classes, points_of

CELLS, SLOTS = 1 << 16, 16
#: Languages that the model may have; more is an error, for the driver holds a table of CELLS for each.
MOST_LANGUAGES = 400
ALWAYS_FITTED, LEAST_MIXED, ROUNDS, SMOOTHING = 4, 0.1, 8, 0.05
UNKNOWN = "und"
TRIGRAM_BASE = 0x2545F4914F6CDD1D  # fixed value: odd multiplier of the trigram hash


@cache
def _lower_case() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(character_classes() == LETTER).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of the trigram around each letter, where the words (runs of letters) begin in them, and the n + 1
    places of the texts' first words."""
    points, at = points_of(data, offsets)
    letter = character_classes()[points] == LETTER
    low = np.where(letter, _lower_case()[points], 0).astype(np.uint64)
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    first = first[: len(points)]
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[first] = 0
    after[:-1][first[1:]] = 0
    cell = (((before * np.uint64(TRIGRAM_BASE) + low) * np.uint64(TRIGRAM_BASE) + after) * np.uint64(TRIGRAM_BASE)) >> np.uint64(48)
    begin = letter & (before == 0)
    letters = np.cumsum(letter) - 1
    begins = np.flatnonzero(begin)
    return cell[letter].astype(np.int64), letters[begins], np.searchsorted(begins, at)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # (CELLS, languages): log probability of each cell


def train(docs: DataFrame) -> Model:
    """Learn from the columns text and lang of all rows of ``docs`` that have both."""
    shared.arrow_rows(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for rows, data, offsets in ts.texts(batches):
            cells, begins, first = trigrams(data, offsets)
            if not len(begins):
                continue
            ends = np.append(begins, len(cells))[first]
            coded = rows.column("lang").dictionary_encode()
            code = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(ends))
            for k, name in enumerate(coded.dictionary.to_pylist()):
                table = tables.setdefault(name, np.zeros(CELLS, np.int64))
                table += np.bincount(cells[code == k], minlength=CELLS)
        for name, table in tables.items():
            parts = table.astype("<i8").reshape(SLOTS, -1)
            yield pa.RecordBatch.from_pydict({"lang": [name] * SLOTS, "slot": np.arange(SLOTS), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // SLOTS, np.int64)
        for batch in tables:
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_buffer(), "<i8")
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "slot": [key[1].as_py()], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    schema = "lang string, slot long, counts binary"
    summed = shared.settle(known.mapInArrow(count, schema).groupBy("lang", "slot").applyInArrow(add, schema), "trigrams")
    languages = [r["lang"] for r in summed.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), SLOTS, CELLS // SLOTS))
    for r in summed.collect():  # CELLS counts for each language, whatever the data
        counts[languages.index(r["lang"]), r["slot"]] = np.frombuffer(bytes(r["counts"]), "<i8")
    counts = counts.reshape(len(languages), CELLS) + SMOOTHING
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return Model(tuple(languages), np.ascontiguousarray(logs, np.float32))


def _fit(like: np.ndarray, share: np.ndarray, owner: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ROUNDS of expectation-maximisation, and the log likelihood of each document."""
    for _ in range(ROUNDS):
        part = like * share[owner]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, begin, axis=0) / size[:, None]
    total = np.log(np.maximum((like * share[owner]).sum(axis=1, dtype=np.float64), 1e-300))
    return share, np.add.reduceat(total, begin)


def mixtures(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages) proportions of the chosen sets of languages; rows of zeros where nothing is known."""
    n, many = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, many))
    cells, begins, first = trigrams(data, offsets)
    size = np.diff(first)
    full = np.flatnonzero(size)
    if not many or not len(full):
        return out
    words = np.stack([np.add.reduceat(model.logs[:, k][cells], begins) for k in range(many)], axis=1)
    like = np.exp(words - words.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    size, begin = size[full], first[:-1][full]
    owner = np.repeat(np.arange(len(full)), size)
    start = np.full((len(full), many), 1 / many, np.float32)
    share, likelihood = _fit(like, start, owner, begin, size)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best, chosen = np.full(len(full), -np.inf), np.zeros((len(full), many))
    going = np.arange(len(full))  # the documents whose larger sets are still fitted
    rose = np.ones(len(full), bool)
    for k in range(1, many + 1):
        if k > ALWAYS_FITTED:
            stay = rose | ((share * (rank == k - 1)).sum(axis=1) * size >= LEAST_MIXED)
            if not stay.any():
                break
            if not stay.all():
                words_of = np.repeat(stay, size)
                like, share, likelihood, rank, size, going = like[words_of], share[stay], likelihood[stay], rank[stay], size[stay], going[stay]
                begin, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        if k < many:
            some = np.where(rank < k, share, 0).astype(np.float32)
            some /= some.sum(axis=1, keepdims=True)
            fitted, value = _fit(like, some, owner, begin, size) if k > 1 else (some, np.add.reduceat(np.log((like * some[owner]).sum(axis=1, dtype=np.float64)), begin))
        else:
            fitted, value = share, likelihood
        value = value - 0.5 * (k - 1) * np.log(size)
        rose = value > best[going]
        best[going[rose]], chosen[going[rose]] = value[rose], fitted[rose]
    out[full] = chosen
    return out


def infer(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its share of the document), languages (array of lang and share, largest first)."""
    spark = docs.sparkSession
    shared.arrow_rows(spark)
    sent = spark.sparkContext.broadcast(model)  # CELLS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for rows, data, offsets in ts.texts(batches):
            share = mixtures(model, data, offsets)
            top = share.argmax(axis=1) if share.shape[1] else np.zeros(len(share), np.int64)
            score = share[np.arange(len(share)), top] if share.shape[1] else np.zeros(len(share))
            top = np.where(score > 0, top, len(names) - 1)
            parts = [[{"lang": names[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0] for s in share]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names[top], pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(parts, kind)], ["doc_id", "lang_pred", "score", "languages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
