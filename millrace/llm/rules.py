"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Measures are expressions over the whole text, rules are bounds on the ratio of two measures in whole percent, and both are
plain data: `compiled` turns any such table into the columns of one select. All sums are integers and ratios are compared
by products, so no result hangs on rounding. A row needs no other row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, quoted, table

#: What parts words: the space and the controls from tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
#: The symbols of the base measure.
SYMBOLS = "#*$%&|<>"
#: Frequent words of English, French, German and Spanish (lower case); the language of a text need not be known.
STOP_WORDS = tuple(sorted({*"the of and to a in is that it for was on with as by be this are at from or not have but".split(), *"de la le et les des en un du une que pour est dans qui par sur pas au avec ne se il".split(), *"der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(), *"el y los se las del por con no una su para al es lo como más o pero sus".split()}))
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lines that begin as items of a list, and lines that break off.
BULLET, ELLIPSIS = "^[ \\t]*([-*\u2022\u25cf\u2023]|[0-9]+[.)])[ \\t]", "([.][.][.]|\u2026)[ \\t\\r]*$"


class Rule(NamedTuple):
    """100 * part has to be within least * whole and most * whole (None: no bound)."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


#: A text that breaks one of these fails whatever the other rules say.
BASE = (Rule("repeats", "n_repeat_words", "n_words", None, 50),)
#: Least number of words.
LEAST_WORDS = 50
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_exclamations", "n_words", None, 20),
    Rule("digits", "n_digits", "word_chars", None, 30),
    Rule("shouting", "n_capitals", "word_chars", None, 40),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("equal_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullets", "n_bullets", "n_lines", None, 90),
    Rule("ellipses", "n_ellipses", "n_lines", None, 30),
)


#: Spellings in which a stop word counts: small, capital or all capital letters, alone or before a comma, stop or colon.
_SPELT = tuple(sorted({f(w) + end for w in STOP_WORDS for f in (str, str.capitalize, str.upper) for end in ("", ",", ".", ":")}))


def _among(text: Column, chars: str) -> Column:
    """Code points of text that are in chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(docs: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """docs with a column for each measure, and those columns by measure; what several need is made once, by a select of its own.

    A window of three words is one number: the upper bits of its hash and, below them, its place. Sorted, equal windows
    stand side by side in order of place; neighbours count as equal only if their words are, so no hash decides.
    """
    keep = list(map(quoted, docs.columns))
    names = {n: free_name(docs, f"quality_{n}") for n in ("text", "words", "lines", "mask", "windows", "places")}
    whole, words, lines, mask, windows, places = map(quoted, names.values())
    n = F.size(words)
    first = docs.select(*keep, text.alias(names["text"]))
    spaced = F.translate(whole, SEPARATORS, " " * len(SEPARATORS))
    second = first.select(*keep, whole, F.array_remove(F.split(spaced, " "), "").alias(names["words"]), F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0).alias(names["lines"]))
    third = second.select(*keep, whole, words, lines, (F.expr(f"shiftleft(1L, length(bin(size(`{names['words']}`))))") - 1).alias(names["mask"]))
    hashed = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i))
    fourth = third.select(*keep, whole, words, lines, mask, F.sort_array(hashed).alias(names["windows"]))

    def pair(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
        same = (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])
        return F.when((a.bitwiseXOR(b) <= mask) & (a.bitwiseXOR(b) > 0) & same, F.array(i, j))

    beside = F.zip_with(windows, F.slice(windows, 2, F.size(windows)), pair)
    fifth = fourth.select(*keep, whole, words, lines, F.sort_array(F.array_distinct(F.flatten(F.filter(beside, lambda p: p.isNotNull())))).alias(names["places"]))
    # A window covers three words, or as many as there are up to the next one.
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    measures = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(whole, SEPARATORS, "")).cast("long"),
        "n_symbols": _among(whole, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x),
        "n_lines": F.size(lines).cast("long"),
        "n_exclamations": _among(whole, "!"),
        "n_digits": _among(whole, "0123456789"),
        "n_capitals": _among(whole, _CAPITALS),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*_SPELT))).cast("long"),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(BULLET))).cast("long"),
        "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike(ELLIPSIS))).cast("long"),
    }
    own = {k: free_name(docs, f"quality_{k}") for k in measures}
    return fifth.select(*keep, *[v.alias(own[k]) for k, v in measures.items()]), {k: quoted(v) for k, v in own.items()}


def compiled(rules: Iterable[Rule], of: dict[str, Column]) -> list[Column]:
    """Of each rule its name where the measures break it, else null."""
    out = []
    for r in rules:
        part, whole = 100 * of[r.part], of[r.whole]
        low = part < r.least * whole if r.least is not None else F.lit(False)
        high = part > r.most * whole if r.most is not None else F.lit(False)
        out.append(F.when(low | high, r.name))
    return out


def judged(docs: DataFrame, rules: Iterable[Rule] = RULES, least_words: int = LEAST_WORDS, text_col: str = "text", into: str = "quality") -> DataFrame:
    """All columns of docs with a struct quality: all measures, base_failed, failed (names of broken rules), kept.

    A null text is an empty one, and an empty one has no words, so it fails `short`; whole texts are read, of any length;
    repeated rows get equal results; an empty table gives an empty result; where docs has a column of the new one's name, in any case, the new
    one gets an underscore more and stands last.
    """
    found, of = measured(docs, F.coalesce(quoted(text_col), F.lit("")))
    base = [F.when(of["n_words"] < least_words, "short"), *compiled(BASE, of)]
    failed = F.array_compact(F.array(*base, *compiled(rules, of)))
    verdict = [F.coalesce(*base).isNotNull().alias("base_failed"), failed.alias("failed"), (F.size(failed) == 0).alias("kept")]
    return found.select(*map(quoted, docs.columns), F.struct(*[v.alias(k) for k, v in of.items()], *verdict).alias(free_name(docs, into)))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], F.array_join("quality.failed", ",").alias("failed"))


def _sql(rules: Iterable[Rule]) -> str:
    """SQL of op12_rules, from the same tables of rules and words."""
    broken = []
    for r in rules:
        bounds = [f"100 * {r.part} {sign} {bound} * {r.whole}" for sign, bound in (("<", r.least), (">", r.most)) if bound is not None]
        broken.append(f"case when {' or '.join(bounds)} then '{r.name}' end")
    stop = ", ".join(f"'{w}'" for w in _SPELT)
    return rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select row, unnest(range(1, len(words) - 1)) as i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as gram from w),
k as (select row, i, count(*) over (partition by row, gram) as times from g),
c as (select row, least(3, coalesce(lead(i) over (partition by row order by i) - i, 3)) as step from k where times > 1),
r as (select row, cast(sum(step) as bigint) as n_repeat_words from c group by row),
m as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(length(regexp_replace(t, '[^!]', '', 'g')) as bigint) as n_exclamations,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(len(lines) as bigint) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         cast(length(regexp_replace(t, '[^0-9]', '', 'g')) as bigint) as n_digits, cast(length(regexp_replace(t, '[^A-Z]', '', 'g')) as bigint) as n_capitals,
         len(list_filter(words, lambda x: x in ({stop}))) as n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) as n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '{ELLIPSIS}'))) as n_ellipses
  from w left join r using (row)),
f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {BASE[0].most} * n_words as base_failed,
             concat_ws(',', case when n_words < {LEAST_WORDS} then 'short' end, {", ".join(broken)}) as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' as kept, failed from f
"""


QUERIES = {"op12_rules": op12_rules}
SQL = {"op12_rules": _sql((*BASE, *RULES))}
