"""Language mixtures, the quality classifier, quotation linking, and the registered queries and pipeline."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pathloom.llm import langmix, queries, quotes, rule_ensemble

SMALL = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_language_mixture(spark):
    docs = read(spark, "documents")
    model = langmix.train(docs.filter(~queries.held_out(4, 2)))
    out = langmix.infer(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter(queries.held_out(4, 2))
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()
    english, german = (docs.filter(F.col("lang") == x).orderBy(F.desc("n_chars")).first().text[:3000] for x in ("en", "de"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, english), (4, english + "\n" + german)], "doc_id long, text string")
    got = {r.doc_id: r for r in langmix.infer(odd, model).collect()}
    assert {got[k].lang_pred for k in (1, 2, 3)} == {"und"} and got[1].score == 0 and got[None].lang_pred == "en"
    assert {x.lang for x in got[4].languages} == {"en", "de"} and 0.3 < got[4].score < 0.7
    empty = langmix.train(docs.limit(0))
    assert {r.lang_pred for r in langmix.infer(odd, empty).collect()} == {"und"} and langmix.infer(odd.limit(0), model).count() == 0


def test_rule_ensemble(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = rule_ensemble.train(docs, labels.filter(~queries.held_out(3, 1)))
    assert model.rules
    both = rule_ensemble.scored(docs, model).join(labels, "doc_id").filter(queries.held_out(3, 1))
    assert both.filter("predicted = quality").count() >= 0.9 * both.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rule_ensemble.scored(odd, model).collect())
    one = rule_ensemble.train(docs, labels.filter("quality = 1"))
    assert not one.rules and rule_ensemble.scored(odd, one).first().predicted == 1
    assert rule_ensemble.scored(odd, rule_ensemble.train(docs, labels.limit(0))).first().score == 0.5


CHAT = [
    (1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "assistant", "> How are you?\n\nFine."), (1, 2, "user", "Ann wrote:\n>> Hello there.\n> Fine.\nGood  indeed"),
    (1, 3, "user", "> hello   THERE.\nback"), (1, 4, "user", None), (None, 0, "user", "x"), (2, 5, "a", "> missing\nz"), (2, 5, "a", "> missing\nz"), (2, None, "a", "y"),
]


def test_quotation_linking(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit("clash"))
    rows = quotes.threads(df).collect()
    assert len(rows) == len(CHAT)
    got = {(r.conv_id, r.turn): r for r in rows}
    assert {t: (got[1, t].reply_to, got[1, t].depth, got[1, t].position, got[1, t].text) for t in range(5)} == {
        0: (None, 0, 0, "Hello there.\n\nHow are you?"), 1: (0, 1, 1, "Fine."), 2: (1, 2, 3, "Good  indeed"), 3: (0, 1, 2, "back"), 4: (3, 2, 4, ""),
    }
    assert got[2, 5].n_quoted == 1 and got[2, 5].n_linked == 0 and got[2, 5].reply_to is None and got[None, 0].thread is None
    assert quotes.threads(df.limit(0)).count() == 0


def test_unquoted_conversations_keep_their_order(spark):
    rows = quotes.threads(read(spark, "conversations")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    for conv in by.values():
        conv.sort(key=lambda r: r.turn)
        assert [r.position for r in conv] == [r.depth for r in conv] == list(range(len(conv)))
        assert [r.reply_to for r in conv] == [None, *[r.turn for r in conv[:-1]]]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_pipeline(spark):
    """Stage by stage: the next works on what the last one kept, and the packed ids are those of the last texts."""
    docs = read(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL).cache()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        assert after.select("doc_id").distinct().count() == after.count()
        docs = after
    left = {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in read(spark, "labels").collect()}
    assert not [i for i in left if labels.get(i) == 0]
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
