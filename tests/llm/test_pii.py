"""Personal data against plain patterns, and what becomes of the sanitised text."""

import random
import re

from millrace.llm import pii
from millrace.llm.common import written

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end(), m[0]))
    return out


def texts():
    r = random.Random(1)
    card = "4539 1488 0343 6467"
    out = ["".join(r.choice(["a", "1", "2.", "@", "b.c", "_", " ", "é😀", "+1 ", "555-", card, "25", "6.", "(3)", "-"]) for _ in range(r.randint(1, 40))) for _ in range(400)]
    return [*out, "", None, "1.2.3.4.5.6.7.8", "0.0.0.256 1.1.1.1", card * 3, "x@y x@y.z@w.v", "+1" + "2" * 14 + " +1" + "2" * 15, "7" * 5000]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.protected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_spans(t or "") for i, t in rows}
    assert {s[0] for spans in got.values() for s in spans} == set(PLAIN)


def test_secrets_and_sanitised_text(spark):
    key = "04dbebab91ab85687d33"
    rows = [(1, f"token = {key}, mail a@b.co or +1 202 555 0100.", "k"), (2, None, "k"), (3, "no data in here", "k"), (3, "no data in here", "l")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, text_key string"), "test")
    got = {r.doc_id: (r.text, r.text_key) for r in pii.sanitised(docs).collect() if r.text_key == "k"}
    assert got[2] == (None, "k") and got[3] == ("no data in here", "k")
    assert "<secret>" in got[1][0] and "<email>" in got[1][0] and "<phone>" in got[1][0] and key not in got[1][0] and got[1][0].endswith(".")


def test_terms_by_an_entity_are_spans_and_its_own_words_are_not(spark):
    plain = [f"the river runs by hill and field {i} in the long valley" for i in range(40)]
    rows = list(enumerate([*plain, "the river. Contact Zoltan at zz.top@mail.org in the valley. Unheard words follow the river"]))
    got = {r.doc_id: {s.value for s in r.terms} for r in pii.protected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zoltan" in got[40] and not got[40] & {"zz", "top", "mail", "org", "the", "river", "Unheard"}
    assert not any(got[i] for i in range(40))
