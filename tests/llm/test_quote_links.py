"""Links of op3 to the right original."""

from pathloom.llm import quotes

CHAT = [
    (1, 0, "Yes."), (1, 1, "Where?"), (1, 2, "Yes."), (1, 3, "> Yes.\nThen go."),  # the later of two originals
    (2, 0, "first line\nsecond line\nthird line"), (2, 1, "aside"), (2, 2, "> second line\nyes"),  # a line of a paragraph
    (3, 0, "Thanks,\nplease send it"), (3, 1, "Thanks,"), (3, 2, "> Thanks,\n> please send it\nsent"),  # the whole goes before its parts
    (4, 0, "x"), (4, 1, "> later\nq"), (4, 2, "later"), (4, 3, "> echo\necho"),  # no original before the quote
]


def threads(spark, rows):
    return {(r.conv_id, r.turn): r for r in quotes.threads(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}


def test_links_go_to_the_latest_original_and_to_lines(spark):
    got = threads(spark, CHAT)
    assert {k: (got[k].reply_to, got[k].n_linked) for k in ((1, 3), (2, 2), (3, 2), (4, 1), (4, 3))} == {(1, 3): (2, 1), (2, 2): (0, 1), (3, 2): (0, 1), (4, 1): (0, 0), (4, 3): (2, 0)}


def test_a_passage_that_all_write_and_quote_over_many_ranges(spark):
    """Conversation of 400 messages: every third writes the passage, every other one quotes it."""
    rows = [(9, t, "the common passage" if t % 3 == 0 else f"> the common passage\nanswer {t}") for t in range(1, 401)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = threads(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for _, t, text in rows:
        if text.startswith(">") and t > 3:
            assert (got[9, t].reply_to, got[9, t].n_linked) == (t - t % 3, 1)
