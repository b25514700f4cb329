"""The language mixtures and the compiled quality score, computed again in plain Python."""

import math
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pathloom.llm import langmix, rule_ensemble

SMALL = "/root/testdata/sf0.001"


def words(text):
    """Cells of the trigrams of each word."""
    found, word = [], []
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] == "L":
            word.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif word:
            padded, cells = [0, *word, 0], []
            for a, b, d in zip(padded, padded[1:], padded[2:], strict=False):
                cells.append(((((a * langmix.TRIGRAM_BASE + b) * langmix.TRIGRAM_BASE + d) * langmix.TRIGRAM_BASE) % (1 << 64)) >> 48)
            found.append(cells)
            word = []
    return found


def fit(like, share):
    for _ in range(langmix.ROUNDS):
        total = [0.0] * len(share)
        for row in like:
            part = [x * s for x, s in zip(row, share, strict=True)]
            for k, x in enumerate(part):
                total[k] += x / sum(part)
        share = [x / len(like) for x in total]
    return share, likelihood(like, share)


def likelihood(like, share):
    return sum(math.log(max(sum(x * s for x, s in zip(row, share, strict=True)), 1e-300)) for row in like)


def mixture(cells, logs):
    """The shares of the best set of languages."""
    many, like = logs.shape[1], []
    for word in cells:
        row = [sum(float(logs[c, k]) for c in word) for k in range(many)]
        like.append([math.exp(x - max(row)) + 1e-12 for x in row])
    share, whole = fit(like, [1 / many] * many)
    ranked = sorted(range(many), key=lambda k: (-share[k], k))
    best, chosen = -math.inf, None
    for k in range(1, many + 1):
        some = [share[j] if j in ranked[:k] else 0.0 for j in range(many)]
        some = [x / sum(some) for x in some]
        fitted, value = (share, whole) if k == many else fit(like, some) if k > 1 else (some, likelihood(like, some))
        value -= 0.5 * (k - 1) * math.log(len(like))
        if value > best:
            best, chosen = value, fitted
    return chosen


def test_mixtures_equal_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = langmix.train(docs)
    rows = docs.filter("text is not null").collect()
    counts = {k: np.full(langmix.CELLS, langmix.SMOOTHING) for k in model.languages}
    for r in rows:
        if r.lang is not None:
            for cells in words(r.text):
                np.add.at(counts[r.lang], cells, 1)
    logs = np.stack([np.log(counts[k] / counts[k].sum()) for k in model.languages], axis=1)
    assert np.allclose(logs, model.logs, rtol=1e-5)

    one = {k: next(r.text for r in rows if r.lang == k and 400 < len(r.text) < 3000) for k in model.languages}
    a, b, *rest = model.languages
    made = [(-1, one[a] + " " + one[b]), (-2, " ".join(one.values())), (-3, " ".join(one[a].split()[:3])), (-4, one[a]), (-4, one[a]), (-5, "x"), (-6, "\n".join(3 * [one[b]]) + one[rest[-1]])]
    texts = [(r.doc_id, r.text) for r in rows if len(r.text) < 2500] + made
    asked = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in texts], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in langmix.infer(asked, model).collect()}
    for i, text in texts:
        cells = words(text)
        if not cells:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        want = mixture(cells, logs)
        top = max(range(len(want)), key=lambda k: (want[k], -k))
        assert got[i].lang_pred == model.languages[top] and got[i].score == pytest.approx(want[top], abs=2e-3), i
        shares = {x.lang: x.share for x in got[i].languages}
        assert all(shares.get(k, 0.0) == pytest.approx(s, abs=2e-3) for k, s in zip(model.languages, want, strict=True)), i
    assert len(got[-2].languages) == len(model.languages)


def statistics(text):
    """The statistics of an ASCII text."""
    found = regex.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(len(found), 1)
    out = {f"s_{k}": len(regex.findall(f"(?a){p}" if not p.startswith("(?i)") else f"(?ai){p[4:]}", text)) / n for k, p in rule_ensemble.PER_WORD.items() if k != "repeats"}
    out["s_repeats"] = sum(1 for _ in regex.finditer(r"(?ai)\b(\w+)\s+\1\b", text)) / n
    return out | {"s_words": math.log1p(len(found)), "s_length": len(text) / n, "s_distinct": len(set(found)) / n, "s_lines": text.count("\n") / n}


def test_compiled_score_equals_the_rules(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = rule_ensemble.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    odd = [(-1, None), (-2, ""), (-3, "word " * 30000), (-4, "A B!! c c C"), (-4, "A B!! c c C"), (-5, " \n\t")]
    every = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"score": F.lit("clash"), "s_words": F.lit(1), "_t": F.lit(2)})
    measured, names = rule_ensemble.with_statistics(every.select("doc_id", "text"))
    rows = {r.doc_id: r for r in measured.collect()}
    ascii_texts = 0
    for r in rows.values():
        if (r.text or "").isascii():
            ascii_texts += 1
            assert {k: pytest.approx(v) for k, v in statistics(r.text or "").items()} == {k: r[k] for k in names}, r.doc_id
    scores = rule_ensemble.scored(every, model).collect()
    assert ascii_texts > 20 and model.rules and len(scores) == every.count()
    for r in scores:
        total = model.intercept
        for rule, weight in model.rules:
            if all(rows[r.doc_id][name] <= bound if side == "<=" else rows[r.doc_id][name] > bound for name, side, bound in rule):
                total += weight
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))) and r.predicted == int(r.score >= 0.5)
    assert rule_ensemble.scored(docs.limit(0), model).count() == 0
