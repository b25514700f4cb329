"""Chat formatting by quotation linking: messages are put in reply order by what they quote.

A line's quote level is the number of ``>`` that it begins with. Consecutive lines of one level are a
passage. The normalised passages, paragraphs and lines that a message writes itself are indexed by digest;
a quoted one links to the latest message before the quote that wrote it. The parts of a passage count only
where the whole has no original, the lines of a paragraph only where the paragraph has none. A message
replies to the latest message that it quotes at level one, else to the latest that it quotes at all, else
to the message before it. ``n_linked`` counts the passages or parts that were linked so. Threads and depths
follow from the replies by pointer doubling.

Originals are carried to the quotes over ranges of rows in the order of (conversation, digest, turn), and the
order inside conversations is counted over such ranges too, so no task sees a whole conversation or all
messages with one passage; the other joins are on (conversation, turn).

Defined results
* null text: no passages; an empty own text. Empty table: empty result.
* repeated rows and rows that share conv_id and turn are one place in the order, and all of them returned.
* null conv_id or turn: the row is returned as it is, without reply, thread, depth or position.
* a quote without an original, or of a later message, links nothing. Columns beside the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import shared

MARKS = r"^((?:[ \t]{0,3}>)+)"
#: How a line ends that announces a quote.
ATTRIBUTION = r"(?i)(wrote|schrieb|escribió|a écrit)\s*:\s*$"
ROUNDS = 64


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """``messages`` with own (text without quotes and announcements) and passages (array of level and text)."""
    lines = messages.withColumn("_l", F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("line"))))
    quote = lambda i: F.coalesce(F.get("_l", i)["level"] > 0, F.lit(False))
    lines = lines.withColumn("_l", F.filter("_l", lambda x, i: ~((x["level"] == 0) & x["line"].rlike(ATTRIBUTION) & quote(i + 1))))
    change = lambda x, i: (i == 0) | (F.get("_l", i - 1)["level"] != x["level"])
    starts = F.filter(F.transform("_l", lambda x, i: F.when(change(x, i), i)), lambda i: i.isNotNull())
    cut = lines.withColumn("_s", starts)
    size = lambda s, k: F.coalesce(F.get("_s", k + 1), F.size("_l")) - s
    one = lambda s, k: F.struct(F.get("_l", s)["level"].alias("level"), F.array_join(F.transform(F.slice("_l", s + 1, size(s, k)), lambda x: x["line"]), "\n").alias("text"))
    own = F.btrim(F.array_join(F.transform(F.filter("_l", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))
    return cut.withColumns({"own": own, "passages": F.transform("_s", one)}).drop("_l", "_s")


def _units(cut: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, paragraph, kind (0 passage, 1 paragraph, 2 line), digest of all units."""
    each = cut.select("conv_id", "turn", F.posexplode("passages").alias("passage", "p"))
    unit = lambda k, kind, text: F.struct(F.lit(k).cast("int").alias("paragraph") if isinstance(k, int) else k.alias("paragraph"), F.lit(kind).alias("kind"), normalised(text).alias("unit"))
    paragraphs = F.split("p.text", r"\n\s*\n", -1)
    lines = F.flatten(F.transform(paragraphs, lambda x, k: F.transform(F.split(x, "\n", -1), lambda line: unit(k, 2, line))))
    parts = F.concat(F.array(unit(-1, 0, F.col("p.text"))), F.transform(paragraphs, lambda x, k: unit(k, 1, x)), lines)
    units = each.select("conv_id", "turn", F.col("p.level").alias("level"), "passage", F.explode(parts).alias("u")).select("conv_id", "turn", "level", "passage", "u.*")
    return units.filter("unit <> ''").select("conv_id", "turn", "level", "passage", "paragraph", "kind", F.unhex(F.sha2("unit", 256)).alias("digest"))


def _originals(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, digest, turn, original: of each quoted digest and turn the latest turn before it that wrote it.

    Counted over ranges as in ``numbered``: a range has the latest original of the ranges before it.
    """
    asked = quoted.select("conv_id", "digest", "turn").distinct()
    wrote = own.join(asked.select("conv_id", "digest").distinct(), ["conv_id", "digest"], "left_semi").select("conv_id", "digest", "turn").distinct()
    rows = asked.withColumn("wrote", F.lit(False)).unionByName(wrote.withColumn("wrote", F.lit(True)))
    order = ["conv_id", "digest", "turn", "wrote"]  # what a message writes comes after what it quotes
    ranged = shared.settle(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "originals")
    turn = F.when(F.col("wrote"), F.col("turn"))
    inside = Window.partitionBy("_part", "conv_id", "digest").orderBy("turn", "wrote").rowsBetween(Window.unboundedPreceding, 0)
    latest = ranged.groupBy("conv_id", "digest", "_part").agg(F.max(turn).alias("_m"))
    before = Window.partitionBy("conv_id", "digest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    carried = latest.select("conv_id", "digest", "_part", F.max("_m").over(before).alias("_before"))
    found = ranged.withColumn("_inside", F.max(turn).over(inside)).filter("not wrote").join(carried, ["conv_id", "digest", "_part"])
    return found.select("conv_id", "digest", "turn", F.coalesce("_inside", "_before").alias("original")).filter("original is not null")


def _replies(quoted: DataFrame, originals: DataFrame) -> DataFrame:
    """conv_id, turn, direct, any, n_linked: the largest linked parts of each quoted passage."""
    linked = quoted.join(originals, ["conv_id", "digest", "turn"])
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("original")))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    one = linked.groupBy("conv_id", "turn", "level", "passage", "paragraph").agg(F.coalesce(at(0), at(1), at(2)).alias("original"), F.coalesce(F.nullif(count(0) + count(1), F.lit(0)), count(2)).alias("n"))
    whole, part = F.col("paragraph") < 0, F.col("paragraph") >= 0
    of = lambda f, c: F.coalesce(f(F.when(whole, F.col(c))), f(F.when(part, F.col(c)))).alias(c)
    best = one.groupBy("conv_id", "turn", "level", "passage").agg(of(F.max, "original"), of(F.sum, "n"))
    direct = F.max(F.when(F.col("level") == 1, F.col("original")))
    return best.groupBy("conv_id", "turn").agg(direct.alias("direct"), F.max("original").alias("any"), F.sum("n").alias("n_linked"))


def numbered(rows: DataFrame, order: list[str], group: str, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in ``group`` by ``order``, counted over ranges: no task sees a group."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = shared.settle(ranged.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "ordered")
    counts = marked.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = marked.join(base, [group, "_part"])
    return placed.withColumn(name, F.col("_before") + F.col("_nth") - F.col("_first")).drop("_part", "_nth", "_first", "_before")


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, thread, depth, position, n_quoted, n_linked.

    In a conversation ``position`` orders threads by their first turn, then by depth, then by turn: every
    message comes after the one it replies to.
    """
    plain = messages.select("conv_id", "turn", "role", "text")
    cut = shared.settle(passages(plain), "passages")
    units = _units(cut.filter("conv_id is not null and turn is not null"))
    quoted = shared.settle(units.filter("level > 0"), "quoted")
    replies = _replies(quoted, _originals(quoted, units.filter("level = 0")))

    turns = cut.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    placed = shared.settle(numbered(turns, ["conv_id", "turn"], "conv_id", "place"), "turns")
    previous = placed.select("conv_id", (F.col("place") + 1).alias("place"), F.col("turn").alias("previous"))
    parents = placed.join(previous, ["conv_id", "place"], "left").join(replies, ["conv_id", "turn"], "left")
    parents = parents.select("conv_id", "turn", F.coalesce("direct", "any", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    parents = shared.settle(parents, "replies")

    # pointer doubling: thread is the ancestor ``depth`` steps above; only messages that haven't reached the
    # first message of their thread are joined again
    roots = F.col("reply_to").isNull()
    state = parents.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("thread"), (~roots).cast("long").alias("depth"), roots.alias("done"))
    state = shared.settle(state, "threads")
    for _ in range(ROUNDS):
        if not state.filter("not done").limit(1).count():
            break
        above = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = state.filter("not done").join(above, ["conv_id", "thread"])
        moved = moved.select("conv_id", "turn", F.col("further").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        state = shared.settle(state.filter("done").unionByName(moved), "threads")
    else:
        raise RuntimeError(f"replies deeper than 2 ** {ROUNDS}")
    state = state.drop("done")
    ordered = numbered(state, ["conv_id", "thread", "depth", "turn"], "conv_id", "position")
    info = ordered.join(parents, ["conv_id", "turn"])
    n_quoted = F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")
    return cut.join(info, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.col("own").alias("text"), "reply_to", "thread", "depth", "position", n_quoted.alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
