"""The registered queries of the language-model operators, opN_<name>, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bytebpe, exact_dedup, id_files, langmix, line_dedup, minhash_join, packing, prefix_trie, quality_rules, quotes, ranked_search, rule_ensemble, shared, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels").filter(~held_out(3, 1)))
    return rule_ensemble.scored(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def held_out(folds: int, fold: int):
    """Whether the CRC-32 of the doc_id as text falls in the fold that is held out; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, shared.scratch(spark, "digest-index"))
    out = index.add(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_kept", "kept")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langmix.train(docs.filter(~held_out(4, 2)))
    return langmix.infer(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bytebpe.installed("byte_bpe_50k.tiktoken")
    out = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("row"), vocabulary)
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids"), digest("decoded"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, bytebpe.installed("byte_bpe_50k.json"), end_id=1, with_ids=False).drop("row")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = id_files.write(docs, bytebpe.installed("byte_bpe_50k.json"), shared.scratch(spark, "ids"), end_id=2)
    return id_files.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("node")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = (
    op1_exact_dedup, op2_quality_rules, op3_quotation_linking, op4_language_mixture, op5_byte_bpe, op6_rule_ensemble, op7_substring_dedup, op8_packing, op9_id_files,
    op10_minhash, op11_line_dedup, op12_ranked_search, op13_prefix_trie,
)

#: Reads ``documents`` as DuckDB sees it.
ORACLES: dict[str, str] = {}

ORACLES["op1_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

ORACLES["op2_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM repeated, range(8) AS o(k) GROUP BY r),
lines AS (SELECT r, unnest(lines) AS line FROM w),
counted AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(line, '[!?]{{2,}}|[#*$%&<>|]{{2,}}')) AS marked, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS different,
         CASE WHEN contains(line, '«') THEN split_part(line, '«', 1) || replace(substring(line, length(split_part(line, '«', 1)) + 1), '»', '') ELSE line END AS unquoted FROM lines),
judged AS (
  SELECT r, line, n, n > 0 AND (
      marked >= n * 0.5 OR symbols >= n * 0.3 OR (n >= 8 AND different <= n * 0.3)
      OR (n <= 2 AND NOT regexp_matches(line, $re${quality_rules.END_MARKS}$re$) AND regexp_matches(line, $re${quality_rules.NAVIGATION}$re$))
      OR len(regexp_extract_all(unquoted, $re${quality_rules.SEPARATORS}$re$)) >= greatest(2, n / {quality_rules.ENTRY_WORDS}::DOUBLE)
      OR len(regexp_extract_all(line, $re${quality_rules.BOILERPLATE}$re$)) >= greatest(1, n / {quality_rules.NOTICE_WORDS}::DOUBLE)) AS fails FROM counted),
by_row AS (SELECT r, count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
                  coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words FROM judged GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, kept_words,
         len(w) < 20 OR 100 * coalesce(n_repeat, 0) > 30 * len(w) AS base_failed
  FROM w JOIN by_row USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CAST(kept_words AS BIGINT) AS n_words_kept,
       NOT base_failed AND n_words - kept_words <= n_words * 0.5 AS kept FROM m
"""

ORACLES["op7_substring_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
v AS (SELECT doc_id, i, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS s, w[i] AS word FROM p),
m AS (SELECT doc_id, i, word, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM v),
c AS (SELECT doc_id, i, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM m),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

ORACLES["op11_line_dedup"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT r, doc_id, i, line, {_LOWER("regexp_replace(line, '^[ " + chr(92) + "x09-" + chr(92) + "x0D]+|[ " + chr(92) + "x09-" + chr(92) + "x0D]+$', '', 'g')")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {line_dedup.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {line_dedup.LEAST_DOCS}),
j AS (SELECT r, i, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM k LEFT JOIN s ON k.key = s.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM j GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)
"""

_TERMS = rf"regexp_extract_all({_LOWER('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace(chr(92) * 2, chr(92))
ORACLES["op12_ranked_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
size AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark))),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, size GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(t) * docs) // terms AS m FROM d, size WHERE len(t) > 0),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {ranked_search.BEST}
"""

#: crc is the table of CRC-32 by byte, made of its polynomial.
ORACLES["op13_prefix_trie"] = rf"""
WITH RECURSIVE bits AS (SELECT range AS i, 0 AS k, range::BIGINT AS x FROM range(256) UNION ALL
  SELECT i, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS crc FROM bits WHERE k = 8),
o AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, t, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS place FROM o),
c AS (SELECT conv_id, conv_id - conv_id % {prefix_trie.FAMILY} AS base, count(*) AS n,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: xor(s >> 8, crc[1 + (xor(s, b) & 255)]))) % {prefix_trie.HEADS} AS heads
  FROM a, crc GROUP BY conv_id, crc),
f AS (SELECT c.*, least(c.heads, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT f.conv_id, place AS pos, t, bytes FROM f JOIN a ON a.conv_id = f.base AND place < heads UNION ALL SELECT conv_id, taken + place - heads, t, bytes FROM f JOIN a USING (conv_id) WHERE place >= heads),
l AS (SELECT f.conv_id, coalesce(list(t ORDER BY pos) FILTER (t IS NOT NULL), []) AS t, coalesce(list(bytes ORDER BY pos) FILTER (t IS NOT NULL), []) AS b FROM f LEFT JOIN r USING (conv_id) GROUP BY f.conv_id),
p AS (SELECT conv_id, len(t) AS size, t, b, unnest(range(0, len(t) + 1)) AS depth FROM l),
n AS (SELECT depth, t[1:depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs, min(b[depth]) AS bytes, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth) AS ends FROM p GROUP BY depth, t[1:depth]),
k AS (SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, key)),
u AS (SELECT above AS depth, key[1:above] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum(coalesce((n_convs - 1) * bytes, 0))::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM x) GROUP BY ALL)
SELECT x.conv_id, x.depth, o.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN u USING (depth, key) LEFT JOIN n o ON o.depth = x.depth - 1 AND o.key = x.key[1:x.depth - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
