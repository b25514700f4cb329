"""Dedup, quality, substring, packing and id operators against brute force on small awkward tables."""

import hashlib
import re
import string
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import bytebpe, exact_dedup, id_files, minhash_join, packing, quality_rules, shared, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = " ".join(f"word{i % 97}x{i % 89}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
BASE = " ".join(f"base{i}" for i in range(100))


def changed(every):
    return " ".join(f"new{i}" if i % every == 3 else w for i, w in enumerate(BASE.split()))


TEXTS = [
    None, "", "   \n\t ", "One", "ONE", "one", "É à", "é à", LONG, LONG, LONG + " tail", f"a b {PASSAGE} c", f"d {PASSAGE}\ne f", PASSAGE, BASE, changed(50), changed(33), changed(10),
    "don't 'tis  漢字 😀\n\n x", "<|endoftext|> x", "the the the the", "a b c d e f g h i j k l m n o p q r s t u v w x y z.", "x" * 5000, "a b c d e", "b a b c d e",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, "nobody's text", None, None, None), (3, "One", "en", "s1", 3), (None, PASSAGE, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit("clash"), "ids": F.lit(1), "kept": F.lit("x"), "chunk": F.lit(2)}).repartition(3)


def ranks(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    vocabulary = bytebpe.installed("byte_bpe_50k.json")
    assert exact_dedup.DigestIndex(spark, shared.scratch(spark, "i")).add(none).count() == 0
    assert quality_rules.judged(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0
    assert minhash_join.near_duplicates(none).count() == 0 and packing.pack(none, vocabulary).count() == 0
    assert id_files.read(id_files.write(none, vocabulary, shared.scratch(spark, "ids"))).count() == 0
    assert bytebpe.decode(bytebpe.encode(none, vocabulary), vocabulary).count() == 0


def test_exact_dedup(spark, docs):
    path = shared.scratch(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    rows = index.add(docs).collect()
    groups = {}
    for i, t in ranks(docs):
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    by_digest = {hashlib.sha256(k.encode()).digest(): v for k, v in groups.items()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    again = exact_dedup.DigestIndex(spark, path).add(docs.union(docs.limit(1).withColumn("text", F.lit("fresh")))).collect()
    assert sum(r.kept for r in again) == 1
    kept = exact_dedup.unique(docs, shared.scratch(spark, "index"))
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_quality_base_counts_and_verdict(docs):
    junk = "# & | " * 30
    extra = docs.limit(1).select(F.lit(900).cast("long").alias("doc_id"), F.lit(junk).alias("text"))
    good = "\n".join(f"Plain line {i} has a{i} few b{i} different c{i} words d{i} to e{i} read." for i in range(6)) + "\nReleased under the MIT License."
    extra = extra.union(extra.select(F.lit(901).cast("long"), F.lit(good)))
    for r in quality_rules.judged(docs.select("doc_id", "text").union(extra)).collect():
        words = WORD.findall(r.text or "")
        seen = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(8)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.kept and r.base_failed)
        if r.doc_id in (900, 901):
            assert r.kept == (r.doc_id == 901) and "MIT" not in r.cleaned
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {14, 21}


@pytest.mark.parametrize(("chunk_bytes", "most_ranges"), [(400, 1 << 14), (400, 3), (1 << 20, 1 << 14)])
def test_substring_dedup(docs, chunk_bytes, most_ranges):
    last = 1 << 60
    rows = ranks(docs)
    first = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - 12):
            window = tuple(words[k : k + 13])
            first[window] = min(first.get(window, last), last if i is None else i)
    want = []
    for i, t in rows:
        words, gone = WORD.findall(t or ""), set()
        for k in range(len(words) - 12):
            if first[tuple(words[k : k + 13])] < (last if i is None else i):
                gone |= set(range(k, k + 13))
        want.append((str(i), len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    out = substring_dedup.remove_repeats(docs, chunk_bytes=chunk_bytes, bucket_windows=50, most_ranges=most_ranges)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == sorted(want)
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[0] is None and texts[18] == TEXTS[18] and "shared5" not in texts[12] and texts[12].endswith("e f")


def sets(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(docs, size):
    some = docs.filter("doc_id is not null")
    all_sets = {i: sets(t, size) for i, t in ranks(some)}
    root = {i: i for i in all_sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(all_sets), 2):
        x, y = all_sets[a], all_sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    rows = minhash_join.near_duplicates(docs, size).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(all_sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    nobody = {r.component_id for r in rows if r.doc_id is None}
    assert nobody == {None, find(13)}
    kept = minhash_join.representatives(docs, size)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("nameless", [False, True])
def test_minhash_takes_ids_of_all_64_bits(spark, nameless):
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [(top, BASE), (top - 1, changed(50)), (1 << 62, LONG), (low, LONG + " tail"), (0, "one of its own kind")] + [(None, changed(33)), (None, "nobody's own text")] * nameless
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_join.near_duplicates(docs, 2).collect()), key=str)
    want = [(top, top - 1, False), (top - 1, top - 1, True), (1 << 62, low, False), (low, low, True), (0, 0, True)] + [(None, top - 1, False), (None, None, True)] * nameless
    assert got == sorted(want, key=str)
    kept = minhash_join.representatives(docs, 2)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([i for i, _, k in want if k], key=str)


def test_minhash_groups_of_many_near_copies(spark):
    """A group too large for one block, with pairs on both sides of the threshold, holds the same components."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(f"v{i}_{k}" if rng.random() < rng.choice([0.0, 0.03, 0.08]) else w for k, w in enumerate(words)) for i in range(300)}
    all_sets = {i: sets(t, 2) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(texts, 2):
        x, y = all_sets[a], all_sets[b]
        if 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    rows = minhash_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in texts}


def reference(text):
    from tokenizers import Tokenizer

    if not hasattr(reference, "t"):
        reference.t = Tokenizer.from_file(bytebpe.installed("byte_bpe_50k.json").path)
        reference.t.encode_special_tokens = True
    return reference.t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_byte_bpe_round_trip_and_spans(docs, name):
    vocabulary = bytebpe.installed(name)
    out = bytebpe.decode(bytebpe.encode(docs, vocabulary, spans=True), vocabulary).collect()
    texts = {r.doc_id: r.text or "" for r in docs.filter("doc_id is not null").collect()}
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is None:
            continue
        ids, raw = np.frombuffer(r.ids, "<u4").tolist(), texts[r.doc_id].encode()
        assert ids == reference(texts[r.doc_id]) and bytes(r.decoded) == raw
        assert len(r.byte_starts) == len(ids) + 1 and r.byte_starts[-1] == len(raw) and r.char_starts[-1] == len(texts[r.doc_id])
        assert r.row.lang == "en" and r.row.row == "clash"


def test_pieces_equal_the_library_on_random_text():
    import random

    from tokenizers.pre_tokenizers import ByteLevel

    rng = random.Random(3)
    pool = "ab z'stremvldSTé ñ\n\t\r 12.,!'\"|#   ́漢字😀Ⅷ²\u0085\x1c"
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    for _ in range(800):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))
        points, at = bytebpe.points_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert bytebpe.pieces(points, at).tolist() == [a for _, (a, _) in split.pre_tokenize_str(text)], repr(text)


def test_packing(docs):
    out = packing.pack(docs, bytebpe.installed("byte_bpe_50k.json"), longest=256).collect()
    by = {}
    for r in out:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    lengths = [r.length for r in sorted(out, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    for i, text in enumerate(TEXTS):
        if i == 3:
            continue  # a repeated row
        ids, got = [*reference(text), 1], sorted(by[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == np.array(ids, "<u4").tobytes() and {r.doc_tokens for r in got} == {len(ids)}
        assert [r.start for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, bytebpe.installed("byte_bpe_50k.json"), longest=100)


def test_id_files(spark, docs):
    manifest = id_files.write(docs, bytebpe.installed("byte_bpe_50k.json"), shared.scratch(spark, "ids"), shard_bytes=20_000)
    assert manifest.count() > 1
    rows = sorted(id_files.read(manifest).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count() and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    named = [r for r in rows if r.doc_id is not None]
    assert [r.doc_id for r in named] == sorted(r.doc_id for r in named) and rows[0].doc_id is None
    for r in named:
        assert np.frombuffer(r.ids, "<u4").tolist() == [*reference(TEXTS[r.doc_id]), 2]
    asked = spark.createDataFrame([(3,), (8,), (777,), (-5,), (None,)], "doc_id long")
    assert sorted(r.doc_id for r in id_files.lookup(manifest, asked).collect()) == [3, 3, 8]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    keys = np.unique(keys)
    found = id_files.PerfectHash.build(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))
