"""The whole pipeline over a small table against a plain version of all five stages."""

import random
import re
import zlib
from itertools import combinations

import numpy as np

import corpus_pipeline
from pathloom.llm import bytebpe, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def line_fails(line):
    words = WORD.findall(line)
    n = len(words)
    if not n:
        return False
    opened = line.find("«")
    unquoted = line if opened < 0 else line[:opened] + line[opened:].replace("»", "")
    hits = lambda pattern, text: sum(1 for _ in re.finditer(pattern, text, re.A))
    return (
        hits(r"[!?]{2,}|[#*$%&<>|]{2,}", line) >= n * 0.5
        or hits(r"[#*$%&|<>]", line) >= n * 0.3
        or (n >= 8 and len(set(WORD.findall(line.lower()))) <= n * 0.3)
        or (n <= 2 and not re.search(quality_rules.END_MARKS, line) and re.search(quality_rules.NAVIGATION, line, re.A) is not None)
        or hits(quality_rules.SEPARATORS, unquoted) >= max(2, n / 8)
        or hits(quality_rules.BOILERPLATE, line) >= max(1, n / 24)
    )


def quality(rows):
    for i, text in rows:
        words = WORD.findall(text or "")
        places = {}
        for k in range(len(words) - 7):
            places.setdefault(tuple(words[k : k + 8]), []).append(k)
        repeated = {k + o for found in places.values() if len(found) > 1 for k in found for o in range(8)}
        if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
            continue
        cleaned = "\n".join(x for x in text.split("\n") if not line_fails(x))
        if len(words) - len(WORD.findall(cleaned)) <= len(words) * 0.5:
            yield i, cleaned


def exact(rows):
    best = {}
    for i, text in rows:
        key = lower(text)
        if key not in best or (-1 if i is None else i) > (-1 if best[key][0] is None else best[key][0]):
            best[key] = (i, text)
    return list(best.values())


def near(rows):
    keys = [LAST if i is None else i for i, _ in rows]
    sets = []
    for _, text in rows:
        words = WORD.findall(lower(text))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(range(len(rows)), key=keys.__getitem__), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)), key=keys.__getitem__)
            root[y] = x
    return [row for k, row in enumerate(rows) if find(k) == k]


def substrings(rows):
    first = {}
    for i, text in rows:
        words = WORD.findall(text)
        for k in range(len(words) - 12):
            window = tuple(words[k : k + 13])
            first[window] = min(first.get(window, LAST), LAST if i is None else i)
    for i, text in rows:
        found = list(WORD.finditer(text))
        gone = set()
        for k in range(len(found) - 12):
            if first[tuple(m.group() for m in found[k : k + 13])] < (LAST if i is None else i):
                gone |= set(range(k, k + 13))
        begins = [m.start() for m in found] + [len(text)]
        out, at = "", 0
        for k in sorted(gone):
            out += text[at : begins[k]] if begins[k] > at else ""
            at = begins[k + 1]
        yield i, out + text[at:]


def packed(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bytebpe.installed("byte_bpe_50k.json").path)
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        start = 0
        while start < len(ids):
            length = min(2048, 1 << ((len(ids) - start).bit_length() - 1))
            yield str(i), start, length, len(ids), zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            start += length


def prose(rng, n_words):
    out = []
    while n_words > 0:
        n = min(n_words, rng.randint(7, 15))
        out.append(" ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(4000)}" for _ in range(n)) + rng.choice(".!?"))
        n_words -= n
    return "\n".join(out)


def fixture():
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(25, 160)) for _ in range(60)]
    passage, common = prose(rng, 55).replace("\n", " "), "Released under the MIT License."
    texts += [None, "", " \n ", "short text.", "# & | " * 40, "\n".join(["the same line again and again."] * 12), prose(rng, 9000)]
    for k in range(0, 12, 2):
        texts += [texts[k], texts[k].upper(), texts[k + 1] + "\n" + common, f"{prose(rng, 30)}\n{passage} {prose(rng, 12)}"]
    for k in range(20, 40):  # some within the threshold, some beyond
        words = re.split("( |\n)", texts[k])
        for _ in range(rng.randint(1, 4)):
            words[2 * rng.randrange(len(words) // 2)] = f"changed{rng.randrange(99)}"
        texts.append("".join(words))
    texts += [prose(rng, 40) + "\nHome | News | Sports | Mail\nLogin\n" + prose(rng, 20), "« " + prose(rng, 30) + " » said | they « so » it was", passage, passage + " " + passage]
    texts += ["Subscribe\n" * 30 + prose(rng, 25), "É" + texts[0], prose(rng, 20) + "\n" + "a b a b a b a b a b a b a b a b\n" + "wow!! so!! much!!"]
    rows = [(k * 3 % 1009, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[5], (None, prose(rng, 50)), (None, texts[8]), (None, passage + " of nobody")]


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "clash", 1) for i, t in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [list(rows)]
    for stage in (quality, exact, near, substrings):
        kept.append(list(stage(kept[-1])))
    sizes = [len(x) for x in kept]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] and kept[3] != kept[4]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], kept[1:], strict=False):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == df.columns
        assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted((str(i), t) for i, t in want), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens, r.ids_crc32) for r in out) == sorted(packed(kept[-1]))
    assert sorted(r.sequence_id for r in out) == list(range(len(out))) and {r.offset for r in out} == {0}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
