"""Look-ups of ids that doubles can't tell apart, and of ids that many rows share."""

import numpy as np

from pathloom.llm import bytebpe, id_files, shared


def test_keys_above_two_to_the_53_find_their_shard(spark):
    big = 1 << 60
    docs = spark.createDataFrame([(big + k, f"text {k} " * 400) for k in range(12)], "doc_id long, text string")
    manifest = id_files.write(docs, bytebpe.installed("byte_bpe_50k.json"), shared.scratch(spark, "ids"), shard_bytes=10_000)
    assert manifest.filter("first_key is not null").count() > 1
    asked = spark.createDataFrame([(big + k,) for k in range(-1, 14)], "doc_id long")
    assert sorted(r.doc_id - big for r in id_files.lookup(manifest, asked).collect()) == list(range(12))


def test_rows_of_one_id_are_spread_over_shards(spark):
    texts = {f"text {k} " * 300 for k in range(40)}
    docs = spark.createDataFrame([(5, t) for t in texts] + [(1, "one"), (9, "nine"), (None, "nobody")], "doc_id long, text string")
    manifest = id_files.write(docs, bytebpe.installed("byte_bpe_50k.json"), shared.scratch(spark, "ids"), shard_bytes=20_000)
    assert manifest.filter("first_key <= 5 and last_key >= 5").count() > 2
    by_key, in_order = (sorted(id_files.read(manifest, by_key=b).collect(), key=lambda r: r.start) for b in (True, False))
    assert by_key == in_order and len(by_key) == 43 and [r.start for r in by_key] == np.cumsum([0, *(r.n_tokens for r in by_key)])[:-1].tolist()
    asked = spark.createDataFrame([(5,), (9,), (6,), (4,)], "doc_id long")
    found = [(r.doc_id, bytes(r.ids)) for r in id_files.lookup(manifest, asked).collect()]
    assert sorted(found) == sorted((r.doc_id, bytes(r.ids)) for r in by_key if r.doc_id in (5, 9))


def test_a_key_that_the_index_loses_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    manifest = id_files.write(docs, bytebpe.installed("byte_bpe_50k.json"), f"file://{tmp_path}/ids")
    row = manifest.first()
    reader = id_files.ShardReader(row.uri)
    assert (reader.places() == np.arange(50)).all()
    reader.first = reader.first[::-1]
    try:
        reader.places()
    except ValueError:
        return
    raise AssertionError("a wrong place went unseen")
