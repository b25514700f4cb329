"""Quality rules, lines first. Native: DataFrame operations only.

Every line of a text is judged by itself: punctuation (most of its words carry runs of marks, or it has no
end mark and hardly a word), symbols, navigation (separators between short entries, or a menu word), boilerplate
(licence, cookie, script and copyright notices, in proportion to the line's words) and repetition (few distinct
words). Lines that fail are removed. A document is rejected if it fails the base rules (too short, too many repeated 8-word windows) or
if it loses more than MOST_LOST of its words with the lines.

All work stays inside the row: repeated windows are found by sorting the row's own window hashes, and only
rows that have a repeat at all are sorted. There is no shuffle.

Defined results
* null text: no words, base_failed, not kept, cleaned null. Empty table: empty result.
* lines without a word neither pass nor fail; they stay between kept lines.
* repeated rows are judged as often as they occur; added columns replace columns of the same name only in
  ``judged``; ``filtered`` returns the columns of its input.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Fixed values of the rules.
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; percent of words in repeated windows
MOST_LOST = 0.5  # share of the words that a document may lose with its lines
MARKED_SHARE, SYMBOL_SHARE, DISTINCT_SHARE, JUDGED_WORDS = 0.5, 0.3, 0.3, 8
ENTRY_WORDS, NOTICE_WORDS = 8, 24  # most words for each separator of a navigation line, for each notice of a boilerplate line
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum"
    r"|licensed under|released under|copyright (\(c\)|©)|©\s*\d{4})"
)
NAVIGATION = r"(?i)^\W*(home|menu|login|log in|sign up|sign in|next|previous|read more|share|skip to content|subscribe|search)\W*$"
SEPARATORS = r"\S\s+[|»›·•]\s+\S"
MARKED = r"[!?]{2,}|[#*$%&<>|]{2,}"
#: What any match of an expression above holds; of BOILERPLATE in lower case, of MARKED if it isn't symbols.
SEPARATOR_MARKS = "|»›·•"
MARKED_PARTS = ("!!", "!?", "?!", "??")
NOTICE_PARTS = ("all rights reserved", "ie policy", "cy policy", "terms of ", "enable javascript", "lorem ipsum", "sed under", "copyright ", "©")
#: Marks that end a sentence or a line of text, in any of the languages.
END_MARKS = r"[.!?…:;\"'”’»)\]。！？]" + SPACE + "*$"


def words_of(text: Column) -> Column:
    for space in "\n\t\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")  # one plain character is no regular expression to split


def _any_of(text: Column, parts: Iterable[str]) -> Column:
    return reduce(operator.or_, [text.contains(part) for part in parts])


def _pairs(hashes: str, apart: int) -> Column:
    """The hash of each value with the one ``apart`` places on."""
    n = F.size(hashes) - apart
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda x, y: F.xxhash64(x, y))


def _covered(places: str) -> Column:
    """Words that lie in windows beginning at the ascending ``places``."""
    return F.aggregate(
        F.col(places),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).cast("long").alias("n")),
        lambda acc: acc["n"],
    )


def _separators(line: Column) -> Column:
    """How many separators stand between entries; a » after a « closes a quotation."""
    open_ = F.substring_index(line, "«", 1)
    unquoted = F.when(line.contains("«"), F.concat(open_, F.translate(F.substring(line, F.length(open_) + 1, F.length(line)), "»", ""))).otherwise(line)
    return F.regexp_count(unquoted, F.lit(SEPARATORS))


def _counted_lines(text: str) -> Column:
    """Each line with its lower case, how many words, different words and symbols it has. A lambda evaluates an
    expression as often as it is named, so what the rules ask for more than once is a field."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("line"), F.lower(line).alias("lower")))
    lines = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["lower"].alias("lower"), words_of(x["lower"]).alias("words")))
    return F.transform(
        lines,
        lambda x: F.struct(
            x["line"].alias("line"),
            x["lower"].alias("lower"),
            F.size(x["words"]).alias("words"),
            F.when(F.size(x["words"]) >= JUDGED_WORDS, F.size(F.array_distinct(x["words"]))).alias("distinct"),
            F.regexp_count(x["line"], F.lit(SYMBOLS)).alias("symbols"),
        ),
    )


def _line_passes(counted: Column) -> Column:
    """Whether a line stays; lines without a word do. Expressions are searched only in lines that hold a part of every match."""
    line, words, symbols = counted["line"], counted["words"], counted["symbols"]
    fails = (
        (((symbols >= 2) | _any_of(line, MARKED_PARTS)) & (F.regexp_count(line, F.lit(MARKED)) >= words * MARKED_SHARE))
        | (symbols >= words * SYMBOL_SHARE)
        | ((words >= JUDGED_WORDS) & (counted["distinct"] <= words * DISTINCT_SHARE))
        | ((words <= 2) & ~line.rlike(END_MARKS) & line.rlike(NAVIGATION))
        | (_any_of(line, SEPARATOR_MARKS) & (_separators(line) >= F.greatest(F.lit(2), words / ENTRY_WORDS)))
        | (_any_of(counted["lower"], NOTICE_PARTS) & (F.regexp_count(line, F.lit(BOILERPLATE)) >= F.greatest(F.lit(1), words / NOTICE_WORDS)))
    )
    return (words == 0) | ~fails


def judged(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cleaned (the text of the lines that stay), n_words_kept and kept."""
    taken = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "n_words_kept", "kept"]
    base = docs.drop(*taken).withColumn("_t", F.coalesce(F.col("text"), F.lit(""))).withColumn("_words", words_of(F.col("_t")))
    windowed = base.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_w": F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))),
        }
    ).drop("_words")
    for apart in (1, 2, 4):  # hashes of two, four, eight words
        windowed = windowed.withColumn("_w", _pairs("_w", apart))
    repeats = F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    lined = windowed.withColumns({"_s": repeats, "_lines": _counted_lines("_t")}).drop("_w", "_t")
    passed = lined.withColumns(
        {
            "n_symbols": F.aggregate("_lines", F.lit(0).cast("long"), lambda n, x: n + x["symbols"]),
            "_full": F.filter("_lines", lambda x: x["words"] > 0)["line"],
            "_kept": F.filter("_lines", _line_passes),
        }
    ).drop("_lines")
    sorted_ = passed.withColumns(
        {
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "cleaned": F.when(F.col("text").isNotNull(), F.array_join(F.col("_kept")["line"], "\n")),
            "n_words_kept": F.aggregate("_kept", F.lit(0).cast("long"), lambda n, x: n + x["words"]),
        }
    ).drop("_full", "_kept")
    same = lambda e, j: F.coalesce(F.get("_s", j)["x"] == e["x"], F.lit(False))
    placed = sorted_.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))).drop("_s")
    counted = placed.withColumn("n_repeat_words", F.coalesce(_covered("_p"), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    counted = counted.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_words_kept") <= F.col("n_words") * MOST_LOST)
    done = counted.withColumn("kept", kept).drop("_p")
    # a later filter on these columns must not be pushed below, where it would be computed inside the lambdas
    return done.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in done.columns]))).alias("_j")).select("_j.*")


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of ``docs`` and their failed lines removed."""
    out = judged(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))).filter("kept")
    columns = [F.col("cleaned").alias("text") if c == "text" else F.length("cleaned").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
