"""Texts that polynomial hashes modulo 2 ** 64 can't tell apart stay different in all operators that hash words."""

import hashlib

import numpy as np
import pytest

from pathloom.llm import bytebpe, exact_dedup, id_files, minhash_join, packing, shared, substring_dedup


def twins(steps):
    """Two words of 2 ** steps letters whose polynomial hashes modulo 2 ** 64 are equal for every odd base."""
    s, t = "a", "b"
    for _ in range(steps):
        s, t = s + t, t + s
    return s, t


WORDS = [w for steps in (10, 11) for w in twins(steps)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, w) for i, w in enumerate(WORDS)] + [(10 + i, " ".join([f"w{k}" for k in range(6)] + [w] + [f"v{k}" for k in range(6)])) for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_encoders_give_each_word_its_own_ids(spark, docs):
    from tokenizers import Tokenizer

    vocabulary = bytebpe.installed("byte_bpe_50k.json")
    library = Tokenizer.from_file(vocabulary.path)
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    decoded = bytebpe.decode(bytebpe.encode(docs, vocabulary), vocabulary)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in decoded.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and bytes(r.decoded).decode() == texts[r.doc_id]
    packed = {}
    for r in sorted(packing.pack(docs, vocabulary).collect(), key=lambda r: r.start):
        packed.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert packed == {k: [*v, 1] for k, v in want.items()}
    stored = id_files.read(id_files.write(docs, vocabulary, shared.scratch(spark, "ids"))).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in stored} == {k: [*v, 2] for k, v in want.items()}


def test_an_encoder_forgets_without_changing_ids(monkeypatch):
    from tokenizers import Tokenizer

    vocabulary = bytebpe.installed("byte_bpe_50k.json")
    library = Tokenizer.from_file(vocabulary.path)
    for name in ("REMEMBERED", "REMEMBERED_IDS", "REMEMBERED_BYTES", "RECENT"):
        monkeypatch.setattr(bytebpe, name, 3)
    get = bytebpe.Encoder(vocabulary)
    for text in ("exactly fifteen?", "sixteen letters..", " interna interna1 international", "pneumonoultramicroscopic words", "ﬁ 漢字漢字漢字漢字 x", "� ok") * 2:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert get(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_windows_and_shingles_differ(docs):
    assert {r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {0}
    for r in minhash_join.near_duplicates(docs.filter("doc_id < 10"), 2).collect():
        assert r.component_id == r.doc_id and r.kept


def test_rows_that_share_an_id_are_one_node(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    a, b = words("a"), words("b")
    docs = spark.createDataFrame([(7, a), (7, b), (3, a), (4, b), (7, ""), (9, words("c"))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash_join.near_duplicates(docs, 2).collect()} == {(7, 3), (3, 3), (4, 3), (9, 9)}


def test_a_reopened_index_finds_its_digests_under_other_settings(spark):
    path = shared.scratch(spark, "index")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path, 4)
    assert first.add(docs, call="one").filter("kept").count() == 400
    # run again under its name, as after a failure behind the append
    assert first.add(docs, call="one").filter("kept").count() == 400 and first.rows().count() == 400
    spark.sql(f"DROP TABLE {first.name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 4 and again.add(docs).filter("kept").count() == 0
        fresh = again.add(docs.limit(1).selectExpr("doc_id", "'new' AS text")).collect()
        assert [r.kept for r in fresh] == [True] and bytes(fresh[0].digest) == hashlib.sha256(b"new").digest()
        with pytest.raises(ValueError, match="buckets"):
            exact_dedup.DigestIndex(spark, path, 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_look_ups_of_large_negative_and_boundary_keys(spark):
    keys = [-(1 << 62), -5, 0, (1 << 53) - 1, 1 << 53, (1 << 53) + 1, (1 << 60) - 1, 1 << 60, (1 << 60) + 1]
    docs = spark.createDataFrame([(k, f"text of {k} " * 20) for k in keys], "doc_id long, text string")
    vocabulary = bytebpe.installed("byte_bpe_50k.json")
    manifest = id_files.write(docs, vocabulary, shared.scratch(spark, "ids"), shard_bytes=400)
    assert manifest.count() > 3
    stored = {r.doc_id: bytes(r.ids) for r in id_files.read(manifest).collect()}
    asked = spark.createDataFrame([(k + d,) for k in keys for d in (-2, 0, 3)], "doc_id long")
    assert {r.doc_id: bytes(r.ids) for r in id_files.lookup(manifest, asked).collect()} == {k: stored[k] for k in keys}


def test_low_bits_of_signatures_are_packed_in_pairs():
    import numpy as np

    from pathloom.llm import minhash_join

    for n in (1, 7, 128):
        sign = np.random.default_rng(n).integers(0, 1 << 32, (5, n)).astype(np.uint32)
        packed = minhash_join._packed(sign)
        assert packed.shape == (5, (n + 1) // 2) and (minhash_join._unpacked(packed, n) == sign % 16).all()
