"""Line dedup, ranked search and the prefix trie against plain Python over awkward tables, and the SQL over the given ones."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import line_dedup, prefix_trie, ranked_search

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"
SHARED, OTHER = "This line is in many documents.", "Another line of more than twenty code points"
ODD = "ÀÉÎÕÜ 漢字 😀 exactly"
TEXTS = [
    None, "", "\n", "\n\n", " \t\x0b ", SHARED, f"  {SHARED.upper()}\r\n{OTHER}", f"{OTHER}\n{SHARED}\n{SHARED}\nshort", f"a\n\t{OTHER}\x0c\nb", "short\nshort", "short", "short\n",
    f"{ODD}\n\n{SHARED}", ODD.ljust(20, "x"), ODD.ljust(20, "x") + "\n", "x" + ODD.ljust(20, "x"), ODD.ljust(20, "x"), ODD.ljust(19, "x"), ODD.ljust(19, "x"), ODD.ljust(19, "x"),
    "don't stop-me_now Été ÉTÉ été 😀a", "\x00a\x7fb", "\n".join(f"line number {i % 700} of a very long text" for i in range(20_000)), "word " * 3000, "alpha beta beta gamma",
    "Alpha BETA", "alpha beta", "alpha beta", OTHER, OTHER,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 7, t, "en") for i, t in enumerate(TEXTS)] + [(None, SHARED, None), (None, "nobody else has got this line\n" * 3, None), (None, "nobody else has got this line", None), (None, "Nobody else has got this line", None), (2, OTHER, "x"), (-1, None, None), (-1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"row": F.lit("clash"), "n": F.lit(1), "n_chars": F.length("text"), "item": F.lit(2), "chunk": F.lit(3)}).repartition(3)


def key(line):
    return line.strip(SPACE).translate(LOWER)


def kept_lines(rows, least_chars=20, least_docs=3):
    holders = {}
    for r, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append((r, i))
    last = {k: max((i for _, i in v if i is not None), default=None) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("chunk_bytes", "shard_keys"), [(1 << 20, 1 << 20), (300, 40)])
def test_line_dedup(docs, chunk_bytes, shard_keys):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.drop_lines(docs, chunk_bytes=chunk_bytes, shard_keys=shard_keys).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in out) == kept_lines(rows)
    assert {r.row.row for r in out} == {"clash"}
    other = line_dedup.drop_lines(docs, least_chars=2, least_docs=2, chunk_bytes=chunk_bytes).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in other) == kept_lines(rows, 2, 2)


def test_without_lines_keeps_columns_and_null_texts(docs):
    out = line_dedup.without_lines(docs)
    assert out.columns == docs.columns and out.schema["n"].dataType == docs.schema["n"].dataType
    want = Counter((str(r.doc_id), r.text is None) for r in docs.collect())
    assert Counter((str(r.doc_id), r.text is None) for r in out.collect()) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_perfect_hash_of_lines_tells_strangers(spark, docs, tmp_path):
    index = line_dedup.LineIndex.build(docs, f"file://{tmp_path}/lines")
    shard = line_dedup.Shard(index.uri(0))
    import numpy as np

    strange = np.random.default_rng(1).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    assert (shard.find(strange) < 0).all() and len(shard.counts) == len({key(x) for t in TEXTS if t for x in t.split("\n") if len(key(x)) >= 20} | {"nobody else has got this line"})


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(rows, items, best):
    terms = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in rows]
    n_docs, total = sum(1 for c in terms if c), sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), c in zip(rows, terms):
            if c:
                m = 50 + (50 * sum(c.values()) * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
                if s > 0:
                    scores.append((-s, i is None, i or 0, i))
        out += [(str(item), rank + 1, str(x[3]), -x[0]) for rank, x in enumerate(sorted(scores)[:best])]
    return sorted(out)


@pytest.mark.parametrize(("best", "pairs", "window"), [(50, 1 << 17, 1 << 14), (3, 4, 64)])
def test_ranked_search(spark, docs, best, pairs, window, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "漢", "Alpha", "beta", "line", "this"]
    more = [(1000 + i // 2, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(300)]
    every = docs.select("doc_id", "text", "item").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("item", F.lit(1)))
    items = [(1, "w1 w2 W3 w3 alpha"), (2, None), (3, ""), (4, "unheard-of 漢 é"), (4, "line"), (5, "THIS beta short"), (None, "w5 été"), (6, "?!"), (7, " ".join(words))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    got = ranked_search.search(every, table, best, pairs).collect()
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got) == ranked([(r.doc_id, r.text) for r in every.collect()], items, best)


def trie_of(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    saved = {k: (len(v) - 1) * len(k[-1][1].encode()) if k else 0 for k, v in nodes.items()}
    children = Counter(k[:-1] for k in nodes if k)
    leaves, sums = Counter(), Counter()
    for k in nodes:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            sums[k[:d]] += saved[k]
    out = []
    for k, v in nodes.items():
        ends = ",".join(str(c) for c in v if len(built[c]) == len(k))
        out.append((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), children[k], leaves[k], sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_prefix_trie(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, ""])) for c in range(-12, 60) for t in range(rng.choice([1, 2, 3, 9, 12])) if c % 7]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(14)]  # a third of the rows alike
    rows += [(200, None, "user", "first"), (200, 5, None, None), (200, 5, None, None), (200, 5, "us", "er:x"), (200, 5, "user", ":x"), (None, 1, "user", "nobody's"), (1 << 62, 1, "user", "far")]
    rows += [(301, t, "user", f"turn {t % 3}") for t in range(150)]  # one long conversation
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"owner": F.lit(1), "depth": F.lit("clash"), "name": F.lit("x")}).repartition(5)
    monkeypatch.setattr(prefix_trie, "AT_ONCE", 5)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(prefix_trie, "MOST_HOT", 20)
    got = prefix_trie.trie(table)
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=str) == trie_of(rows)
    assert prefix_trie.trie(table.limit(0)).count() == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    assert line_dedup.drop_lines(none).count() == 0 and line_dedup.without_lines(none).count() == 0
    assert ranked_search.search(none, items).count() == 0 and ranked_search.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_ranked_search", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from pathloom.llm import queries

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))
