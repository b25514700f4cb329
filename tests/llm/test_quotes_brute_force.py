"""Quotation linking against a plain version that follows the definition, on random nested quotes."""

import random
import re

from pathloom.llm import quotes

MARKS = re.compile(r"^((?:[ \t]{0,3}>)+) ?")
WROTE = re.compile(r"(wrote|schrieb|escribió|a écrit)\s*:\s*$", re.I | re.A)
PHRASES = ["Yes.", "No, not at all", "see you  on Monday", "Where is it?", "It is HERE", "it is here", "I agree", "Thanks a lot", "The meeting was long", "Why so late", "Bring the map", "Rain is likely"]


def message(rng, earlier):
    lines = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.45 or not earlier:
            lines += [rng.choice(PHRASES) for _ in range(rng.randint(1, 3))]
            lines += [""] * rng.randint(0, 2)
            continue
        if kind < 0.55:
            lines.append("Ann wrote:")
        source = rng.choice(earlier).split("\n")
        begin = rng.randrange(len(source))
        mark = rng.choice(["> ", ">", " > "])
        lines += [mark + x for x in source[begin : begin + rng.randint(1, 5)]]
        if kind > 0.9:
            lines.append("> " + rng.choice(PHRASES).upper())
    return "\n".join(lines)


def normal(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def parsed(text):
    """Own text and passages (level, text) of a message."""
    lines = []
    for line in re.split("\r?\n", text or ""):
        found = MARKS.match(line)
        lines.append((found.group(1).count(">") if found else 0, line[found.end() :] if found else line))
    kept = [x for i, x in enumerate(lines) if not (x[0] == 0 and WROTE.search(x[1]) and i + 1 < len(lines) and lines[i + 1][0] > 0)]
    out = []
    for level, line in kept:
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    own = "\n".join(line for level, line in kept if level == 0).strip(" \t\r\n")
    return own, [(level, "\n".join(block)) for level, block in out]


def paragraphs(text):
    return re.split(r"\n[ \t\n\x0b\f\r]*\n", text)


def plain(conversation):
    """turn -> (own, reply_to, depth, position, n_quoted, n_linked) of messages in order of their turns."""
    read = [(turn, *parsed(text)) for turn, text in conversation]
    wrote = {}
    for turn, _, found in read:
        for level, text in found:
            if level == 0:
                for unit in [text, *paragraphs(text), *text.split("\n")]:
                    wrote.setdefault(normal(unit), set()).add(turn)
    wrote.pop("", None)
    replies, out = {}, {}
    for k, (turn, own, found) in enumerate(read):

        def latest(unit, turn=turn):
            return max((t for t in wrote.get(normal(unit), ()) if t < turn), default=None)

        direct, any_, linked = [], [], 0
        for level, text in found:
            if level == 0:
                continue
            best, n = latest(text), 1
            if best is None:
                parts = []
                for p in paragraphs(text):
                    if latest(p) is not None:
                        parts.append(latest(p))
                    else:
                        parts += [t for t in map(latest, p.split("\n")) if t is not None]
                best, n = max(parts, default=None), len(parts)
            if best is not None:
                any_.append(best)
                direct += [best] if level == 1 else []
                linked += n
        previous = read[k - 1][0] if k else None
        replies[turn] = max(direct) if direct else max(any_) if any_ else previous
        out[turn] = (own, sum(level > 0 for level, _ in found), linked)
    depth, first = {}, {}
    for turn, parent in replies.items():
        depth[turn] = 0 if parent is None else depth[parent] + 1
        first[turn] = turn if parent is None else first[parent]
    order = sorted(replies, key=lambda t: (first[t], depth[t], t))
    return {t: (own, replies[t], first[t], depth[t], order.index(t), q, n) for t, (own, q, n) in out.items()}


def test_random_nested_quotes(spark):
    rng = random.Random(11)
    conversations, linked, deep = {}, 0, 0
    for conv in range(60):
        texts = []
        for _ in range(rng.randint(1, 14)):
            texts.append(message(rng, texts))
        conversations[conv] = list(zip(sorted(rng.sample(range(-5, 60), len(texts))), texts, strict=True))
    rows = [(conv, turn, "user", text) for conv, messages in conversations.items() for turn, text in messages]
    long = "\n\n".join(f"paragraph {i} of a very long message" for i in range(3000))
    conversations[99] = [(0, long), (1, None), (2, "> " + long.replace("\n", "\n> ")), (3, "> paragraph 2999 of a very long message")]
    rows += [(99, turn, "user", text) for turn, text in conversations[99]]
    got = {}
    for r in quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.text, r.reply_to, r.thread, r.depth, r.position, r.n_quoted, r.n_linked)
    for conv, messages in conversations.items():
        want = plain(messages)
        assert got[conv] == want, conv
        linked += sum(x[-1] for x in want.values())
        deep += sum(x[1] not in (None, max((t for t in want if t < turn), default=None)) for turn, x in want.items())
    assert linked > 200 and deep > 50 and got[99][2][1] == 0
