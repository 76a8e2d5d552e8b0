"""Winnowing and its extension, against brute force over random texts of few words."""

import hashlib
import random
import re

import pytest

from gridweave.llm.chat import turn_rows
from gridweave.llm.decontam import contaminated
from gridweave.llm.queries import ship

DOCS, ITEMS = "doc_id long, text string, tk string, w string", "item_id string, text string, fp long"


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    wins = {}
    for item, text in items:
        w = word_list(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = word_list(text), set(), set()
        for n in range(1, size + 1):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        found.discard(None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, size=10):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS)
    return sorted(map(tuple, contaminated(d, b, window=size).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_equal_brute_force(spark, seed):
    ship(spark)
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice("aBcdEf") + str(r.randint(0, 3)) for _ in range(n))
    items = [(f"i{i}", say(r.randint(10, 30))) for i in range(8)] + [("short", say(4)), ("two", "a1 d2"), ("none", "--"), ("null", None), (None, say(12)), ("i0", say(11))]
    docs = [(i, say(r.randint(0, 60))) for i in range(20)]
    docs += [(100 + i, say(r.randint(0, 9)) + " " + (t or "") + ". " + say(5)) for i, (_, t) in enumerate(items)]
    docs += [(100, docs[25][1]), (None, docs[24][1]), (200, None), (201, ""), (202, "only " * 20000 + items[3][1]), (203, items[1][1] * 50)]
    # a passage one word short of a window, at both ends of a text
    docs += [(204, " ".join(items[2][1].split()[:9])), (205, "x " + " ".join(items[2][1].split()[-9:])), (206, " ".join(items[2][1].split()[-10:]))]
    assert run(spark, docs, items) == brute(docs, items, 10)


def test_one_short_item_alone_and_other_windows(spark):
    docs = [(1, "one two three"), (2, "two"), (3, None)]
    assert run(spark, docs, [("a", "Two")]) == brute(docs, [("a", "Two")], 10)
    items = [("a", "p q r s"), ("b", "r s t")]
    docs = [(1, "p q r s t"), (2, "q r s x r s t"), (3, "p q")]
    for size in (1, 3, 4):
        assert run(spark, docs, items, size) == brute(docs, items, size)


def test_empty_tables(spark):
    docs = [(1, "one two three"), (None, None)]
    assert run(spark, docs, []) == brute(docs, [], 10)
    assert run(spark, [], [("a", "one")]) == []


def test_turns_go_through_the_layouts(spark):
    rows = [(1, 0, "human", 'a "quoted" \\ line\n \x01 😀'), (1, 1, "gpt", None), (1, 1, "gpt", None), (2, 0, None, ""), (None, 5, "user", "x" * 300000), (3, None, "system", '{"role": 1}')]
    d = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, pos long")
    got = sorted(map(tuple, turn_rows(d, "conv_id", "turn", "role", "text").collect()), key=str)
    name = {"human": "user", "gpt": "assistant"}
    assert got == sorted(((c, t, name.get(r, r or ""), x or "") for c, t, r, x in rows), key=str)
    assert turn_rows(d.limit(0), "conv_id", "turn", "role", "text").count() == 0
