"""Quality rules against a plain count of every measure, and the edge cases."""

import random
import re

from millrace.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {i + k for i in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_counts(spark):
    r = random.Random(12)
    few = ["a", "b", "the", "x#", "ü", "Ab", " ", "…", "9.", "&|"]
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a a a", "x y z x y z", "one\n\none\n one\n", "the\r\nthe\r\n", "a " * 20_000]
    texts += ["".join(r.choice(few) + r.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for _ in range(r.randrange(200))) for _ in range(150)]
    texts += [" ".join(f"w{r.randrange(400)}" for _ in range(5_000))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, QUALITY string")
    got = {g.doc_id: g for g in rules.judged(docs).collect()}
    for i, t in enumerate(texts):
        q = got[i].quality_
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain(t), t and t[:80]
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert got[i].QUALITY == "x" and q.kept == (not q.failed) and not (q.base_failed and q.kept)


def test_rules_name_what_is_wrong(spark):
    r = random.Random(7)
    clean = " ".join(w for _ in range(40) for w in ("the", "".join(r.choices("abcdefgh", k=7)), "of", "".join(r.choices("mnopqrst", k=7))))
    words = clean.split()
    cases = {"": clean, "short": " ".join(words[:20]), "symbols": " ".join(f"{w}***" for w in words[::2]), "exclamations": "!! ".join(words), "shouting": clean.upper(), "stop_words": " ".join(words[1::2]), "equal_lines": clean + "\nthe end of it" * 3, "bullets": "\n".join(f"- {w} a{i}" for i, w in enumerate(words)), "ellipses": "\n".join(f"{w} a{i}..." for i, w in enumerate(words)), "digits": " ".join(f"the 12345678{i}" for i in range(60))}
    docs = spark.createDataFrame([(k, t) for k, t in cases.items()], "doc_id string, text string")
    for row in rules.judged(docs).collect():
        assert row.doc_id in row.quality.failed if row.doc_id else row.quality.failed == [], row


def test_own_table_of_rules_and_clashing_columns(spark):
    names = ["quality_text", "quality_words", "quality_n_words", "words", "kept", "failed", "q`uoted"]
    docs = spark.createDataFrame([(1, "a b c", *range(len(names))), (1, "a b c", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names[:-1]) + ", last int")
    out = rules.judged(docs, [rules.Rule("long_words", "word_chars", "n_words", 200, None)], least_words=1, into="Kept")
    assert out.columns == [*docs.columns, "Kept_"]
    for row in out.collect():
        assert row.kept == 4 and row.quality_text == 0 and row.last == 6 and row.Kept_.failed == ["long_words"]
    assert rules.judged(docs.limit(0)).count() == 0


def test_no_shuffle_and_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
