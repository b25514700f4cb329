"""Line rules of op2 on lines of any length."""

import random

import pytest

from pathloom.llm import quality_rules

PROSE = " ".join(f"wort{i} folgt{i} dann{i}" for i in range(40))


@pytest.mark.parametrize(
    "line, stays",
    [
        ("Il a dit « oui » puis « non » et il est parti sans se retourner.", True),
        (f"{PROSE} | {PROSE} | {PROSE}.", True),
        (f"{PROSE} as the privacy policy says {PROSE}.", True),
        (f"{PROSE} licensed under the terms {PROSE}.", True),
        ("Home | Products and services | About us | Contact", False),
        ("Home » Products » Shoes » Red", False),
        ("Accueil » Produits » Chaussures « Rouge »", False),
        ("Read our privacy policy.", False),
        ("Released under the MIT License.", False),
        (" ".join(["All rights reserved. Privacy policy. Terms of use."] * 9), False),
    ],
)
def test_line_rules_are_relative_to_the_line(spark, line, stays):
    text = f"{line}\nA last line."
    got = quality_rules.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.cleaned == (text if stays else "A last line.")


def test_the_query_equals_its_sql_on_long_lines(spark, tmp_path):
    """Lines with separators, notices and quotation marks of any length, as the given tables have few of them."""
    duckdb = pytest.importorskip("duckdb")
    from pathloom.llm import queries

    lines = [
        "He said « yes » and then « no » » to all of them " + " ".join(f"so{i} it{i}" for i in range(12)), f"{PROSE} as the privacy policy says {PROSE}.", f"{PROSE} | {PROSE} | {PROSE}.",
        "Home | Products and services | About us | Contact", "Accueil » Produits » Chaussures « Rouge »", "Read our privacy policy.", f"{PROSE} « a » » b » » c {PROSE}", " · ".join(f"x{i}" for i in range(9)),
        " | ".join(" ".join(f"w{i}{k}" for k in range(7)) for i in range(5)), " | ".join(" ".join(f"w{i}{k}" for k in range(9)) for i in range(5)),
    ]
    rows = [(i, f"{line}\n{PROSE}") for i, line in enumerate(lines)] + [(100 + i, line) for i, line in enumerate(lines)] + [(200, "\n".join(lines)), (201, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op2_quality_rules(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()['op2_quality_rules']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))


def test_a_line_is_counted_once(spark):
    """Lambdas evaluate a repeated expression each time: counting a line's words where a rule asks for them took most of the time."""
    df = quality_rules.judged(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4  # symbols, marks, separators, notices
    assert plan.count("split(") == 3  # words of the text, its lines, words of a line


def test_random_lines_against_plain_rules(spark):
    """Lines of odd pieces: what is searched first in a line may not hide a match of the whole expression."""
    from test_pipeline_brute_force import WORD, line_fails

    random.seed(7)
    pieces = [
        "!!", "?!", "!?", "!", "?", "#*", "#", "$ %", "<a>", "a|b", " | ", "|", " » ", "»", "«", "›", " · ", "•", "All RIGHTS reserved", "COOKIE Policy", "privacy POLICY", "Terms Of Use", "terms of  use",
        "TERMS OF service", "Enable JavaScript", "LOREM ipsum", "Licensed Under", "RELEASED under", "Copyright (C)", "copyright ©", "©2020", "© \t1999", "©", "Home", "SKIP TO CONTENT", "read more", "…", "。", "Σ", "ΌΣΟΣ", "İ", "ſ",
        "K", " ", "漢字", "😀", "One", "one", "ONE", "word", "other", "\t", "\x0b", "\x0c", "\r", " ", "  ", "und so weiter",
    ]
    texts = ["\n".join(random.choice(("", " ")).join(random.choices(pieces, k=random.choice((0, 1, 2, 3, 5, 9, 20)))) for _ in range(30)) for _ in range(60)]
    texts += [" ".join(random.choices("abc", k=400)) for _ in range(5)] + [f"{x}\n{x}\r\n{x}" for x in texts[:5]] + [f"\ta\x0bb{PROSE}\x0c{PROSE}\r"]
    seen = set()
    for r in quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect():
        words, places = WORD.findall(r.text), {}
        for k in range(len(words) - 7):
            places.setdefault(tuple(words[k : k + 8]), []).append(k)
        repeated = {k + o for found in places.values() if len(found) > 1 for k in found for o in range(8)}
        cleaned = "\n".join(x for x in r.text.split("\n") if not line_fails(x))
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text), len(repeated), cleaned, len(WORD.findall(cleaned)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words, r.cleaned, r.n_words_kept) == want
        seen |= {line_fails(x) for x in r.text.split("\n")} | {bool(repeated)}
    assert seen == {False, True}
