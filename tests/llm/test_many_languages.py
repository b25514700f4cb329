"""Mixtures of op4 of more than four languages."""

import numpy as np

from pathloom.llm import langmix

NAMES = [f"l{k}" for k in range(9)]


def words(k, n, seed):
    """Words of language k, which has three letters of its own."""
    rng = np.random.default_rng(seed * 100 + k)
    letters = "abcdefghijklmnopqrstuvwxyzß"[3 * k : 3 * k + 3]
    return ["".join(rng.choice(list(letters), 5)) for _ in range(n)]


def test_a_text_in_seven_languages_has_them_all(spark):
    train = spark.createDataFrame([(name, " ".join(words(k, 400, 1))) for k, name in enumerate(NAMES)], "lang string, text string")
    text = " ".join(w for k in range(7) for w in words(k, 30, 2))
    pair = " ".join(words(3, 40, 3) + words(8, 20, 3))
    docs = spark.createDataFrame([(1, text), (2, pair), (3, " ".join(words(5, 10, 4)))], "doc_id long, text string")
    got = {r.doc_id: r for r in langmix.infer(docs, langmix.train(train)).collect()}
    assert {x.lang for x in got[1].languages} == set(NAMES[:7]) and all(abs(x.share - 1 / 7) < 0.02 for x in got[1].languages)
    assert abs(got[1].score - 1 / 7) < 0.02
    assert {x.lang for x in got[2].languages} == {"l3", "l8"} and [x.lang for x in got[3].languages] == ["l5"]
