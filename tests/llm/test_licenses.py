"""Licenses against plain search, and chains over broken texts."""

import random
import re

from millrace.llm import licenses

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    found = [(i, label) for i in range(len(words)) for p, label in licenses.PHRASES.items() if words[i : i + len(p.split())] == p.encode().split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_equals_plain_search(spark):
    r = random.Random(1)
    parts = ["GNU general", "General Public License", "gnu", "apache", "License", "CC BY", "cc", "by", "MIT  license", "x", "é", "-", "\n", "mit", "[", "\x00", "9"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", "gnu general public license" * 2, "cc-by cc_by CC BY"]
    got = licenses.licensed(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)).collect()
    assert {r.i: tuple(r.license)[:5] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_every_place_of_a_state_is_known():
    sam = licenses.Automaton([[1, 2, 3, 1, 2], [2, 1, 2]])
    for pattern, ends in (([1, 2], [(0, 2), (0, 5), (1, 3)]), ([2], [(0, 2), (0, 5), (1, 1), (1, 3)]), ([3, 1, 2], [(0, 5)])):
        state = n = 0
        for t in pattern:
            state, n = sam.step(state, n, t)
        assert n == len(pattern) and sam.ends[state] == ends


def test_chains_go_over_insertions_and_repeats():
    scanner, words = licenses.Scanner(), licenses.TEMPLATES["mit-text"].split()
    for at in (10, 14, 16, 17, 20):
        for inserted in (words[at - 4 : at], ["and", "some", "other", "thing"]):
            _, _, spans = scanner.scan(" ".join(["x", *words[:at], *inserted, *words[at:], "y"]))
            assert [(label, start, end) for label, start, end, _ in spans] == [("mit-text", 1, 1 + len(words) + 4)], (at, inserted)
    twice = " ".join(words + ["gap"] * 50 + words)
    assert [(s, e) for _, s, e, _ in scanner.scan(twice)[2]] == [(0, len(words)), (len(words) + 50, 2 * len(words) + 50)]
    assert [s[3] for s in scanner.scan(" ".join(words + words))[2]] == [1.0, 1.0]
    assert scanner.scan(" ".join(words[: len(words) // 2]))[2] == []


def test_many_copies_of_a_template_in_a_row():
    words = licenses.TEMPLATES["mit-text"].split()
    spans = licenses.Scanner().scan(" ".join(words * 3000))[2]
    assert [(s, e) for _, s, e, _ in spans] == [(i * len(words), (i + 1) * len(words)) for i in range(3000)]
