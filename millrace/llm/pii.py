"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities: e-mails, addresses of machines, cards, phones, and secrets (long runs of letters
and digits mixed). A term co-occurs with the entities next to it, before and after, in its sentence; so a text gives at
most two pairs for each of its terms. P(entity | term) is estimated in distinct texts over the whole corpus, smoothed
towards the entity's own share of all texts, so that a term seen once counts with less than certainty. Terms that close
enough of the gap between that share and certainty become spans too, wherever they stand, and are generalised, like the
entities, in the sanitised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, small, table, text_or_empty, written

#: Possessive loops and run starts keep long texts linear; matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The method's own kind: runs of at least 20 letters and digits with both among them.
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+"
#: Kinds in the order of the result.
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": SECRET}
BASE = ("email", "ip", "card", "phone")
#: What a text needs for a match of any kind; cheaper than the patterns.
ANY = ("@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){12}", r"\+[0-9]", r"[A-Za-z0-9]{20}")
#: Texts that the entity's own share counts for, and the part of the gap to certainty that makes a term a span.
SMOOTH, DISCLOSURE = 0.5, 0.5
TERM = r"\p{L}[\p{L}\p{M}]+"
SENTENCE = r"(?s).+?(?:[.!?]\s+|\n\s*\n|\z)"
#: Keys up to which a table of them may be broadcast.
KEYS = 400_000
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = F.reverse(_digits(c))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    n = F.length(_digits(c))
    if kind == "ip":
        return c.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(c)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _pieces(texts: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, i, start, end, value of every match and, where value is null, of the end of the text; places count from the text's start.

    Lengths of the pieces between matches are summed over rows, so a text with many matches costs no more for each.
    """
    zipped = F.arrays_zip(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    rows = texts.select(*keys, F.posexplode(zipped).alias("i", "x"))
    length = F.length("x.p") + F.coalesce(F.length("x.m"), F.lit(0))
    ended = rows.withColumn("end", F.sum(length).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return ended.select(*keys, "i", (F.col("end") - F.coalesce(F.length("x.m"), F.lit(0))).alias("start"), "end", F.col("x.m").alias("value"))


def spans_of(texts: DataFrame) -> DataFrame:
    """text_key, kind, start, end, value of every valid match in texts (text_key, text)."""
    found = None
    for kind, pattern in KINDS.items():
        own = _pieces(texts.filter(F.col("text").rlike(pattern)).withColumn("kind", F.lit(kind)), ["text_key", "kind"], "text", pattern)
        own = own.filter(F.col("value").isNotNull()).filter(_valid(kind, F.col("value"))).drop("i")
        found = own if found is None else found.unionByName(own)
    return found


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def neighbours(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """text_key, term, entity: terms with the entities next to them in the sentence in which the entity begins."""
    whole = texts.select("text_key", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("n", "piece"))
    ended = F.sum(F.length("piece")).over(Window.partitionBy("text_key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    sentences = written(whole.withColumn("at", ended - F.length("piece")), "pii_sentences")
    # The last sentence that begins before an entity holds its beginning.
    marks = sentences.select("text_key", "at", F.col("n"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("bigint").alias("end"))
    marks = marks.unionByName(spans.select("text_key", F.col("start").alias("at"), F.lit(None).cast("int").alias("n"), F.sha2("value", 256).alias("entity"), "end"))
    before = Window.partitionBy("text_key").orderBy("at", F.col("n").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    held = written(marks.withColumn("n", F.last("n", True).over(before)).filter("entity is not null"), "pii_held")
    own = sentences.join(held.select("text_key", "n").distinct(), ["text_key", "n"])
    terms = _pieces(own, ["text_key", "n", "at"], "piece", TERM).filter("value is not null")
    terms = terms.select("text_key", "n", (F.col("at") + F.col("start")).alias("at"), F.col("value").alias("term"))
    both = terms.unionByName(held.select("text_key", "n", "at", F.struct("end", "entity").alias("e")), True)
    forward = Window.partitionBy("text_key", "n").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("text_key", "n").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"left": F.last("e", True).over(forward), "right": F.last("e", True).over(back)}).filter("term is not null")
    # Words inside an entity are the entity's.
    near = near.filter(F.col("left").isNull() | (F.col("left.end") <= F.col("at")))
    pairs = near.select("text_key", "term", F.explode(F.array_compact(F.array("left.entity", "right.entity"))).alias("entity")).distinct()
    out = written(pairs, "pii_pairs")
    dropped(sentences, held)
    return out


def disclosing(docs: DataFrame, keys: DataFrame, pairs: DataFrame, spans: DataFrame, text_col: str) -> DataFrame:
    """text_key, term: the texts that hold a disclosing term."""
    counted = keys.groupBy("text_key").agg(F.count("*").alias("copies"))
    everything = counted.count()
    common = spans.select(F.sha2("value", 256).alias("entity"), "text_key").distinct().groupBy("entity").agg(F.count("*").alias("texts"))
    together = written(pairs.groupBy("entity", "term").agg(F.count("*").alias("n")), "pii_together")
    # A text that stands on several rows counts once: each of its rows has its part of 1.
    text = text_or_empty(text_col)
    repeated = written(counted.filter("copies > 1"), "pii_copies")
    asked = written(together.select("term").distinct(), "pii_terms")
    part = docs.select(F.md5(text).alias("text_key"), text.alias("text")).join(small(repeated, KEYS), "text_key", "left")
    spread = part.select(F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("part"), F.explode(_terms(F.col("text"))).alias("term"))
    spread = spread.join(small(asked, KEYS), "term", "left_semi").groupBy("term").agg(F.round(F.sum("part")).alias("df"))
    share = F.col("texts") / everything
    given = (F.col("n") + SMOOTH * share) / (F.col("df") + SMOOTH)
    known = written(together.join(spread, "term").join(common, "entity").filter((given > share) & (given - share >= DISCLOSURE * (1 - share))).select("term").distinct(), "pii_strong")
    terms = docs.select(F.md5(text).alias("text_key"), F.explode(_terms(text)).alias("term"))
    out = written(terms.join(small(known, KEYS), "term", "left_semi").distinct(), "pii_hits")
    dropped(together, repeated, asked, known)
    return out


def found_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keys of all rows, and text_key, kind, start, end, value of every span of the distinct texts, terms among them."""
    text = text_or_empty(text_col)
    keys = written(docs.select(F.md5(text).alias("text_key")), "pii_keys")
    maybe = F.col("text").contains(ANY[0])
    for pattern in ANY[1:]:
        maybe = maybe | F.col("text").rlike(pattern)
    own = docs.select(F.md5(text).alias("text_key"), text.alias("text"))
    texts = written(own.filter(maybe).groupBy("text_key").agg(F.first("text").alias("text")), "pii_texts")
    spans = written(spans_of(texts), "pii_spans")
    pairs = neighbours(texts.join(spans.select("text_key").distinct(), "text_key", "left_semi"), spans)
    hits = disclosing(docs, keys, pairs, spans, text_col)
    marked = written(hits.groupBy("text_key").agg(F.collect_set("term").alias("terms")), "pii_marked")
    held = written(own.join(small(marked, KEYS), "text_key").groupBy("text_key").agg(F.first("text").alias("text")), "pii_held")
    places = _pieces(held, ["text_key"], "text", TERM).filter("value is not null")
    terms = places.join(hits, (places["text_key"] == hits["text_key"]) & (places["value"] == hits["term"])).select(places["text_key"], F.lit("term").alias("kind"), "start", "end", "value")
    out = written(spans.unionByName(terms), "pii_all")
    dropped(texts, spans, pairs, hits, marked, held)
    return keys, out


def protected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base, terms: spans (kind, start, end, value) of every row of docs, places in code points.

    base has the kinds of BASE in that order and by start, terms the method's own: secrets, then terms. Null and empty
    texts have no spans; whole texts are read; repeated rows get equal results; an empty table gives an empty result;
    other columns are ignored. Equal texts count once in the statistics.
    """
    _, spans = found_spans(docs, text_col)
    order = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "term"]]), F.col("kind"))
    listed = spans.withColumn("own", F.struct(order.alias("o"), "start", "end", "kind", "value")).groupBy("text_key").agg(F.sort_array(F.collect_list("own")).alias("all"))

    def some(base: bool) -> Column:
        kept = F.filter("all", lambda s: s["kind"].isin(*BASE) if base else ~s["kind"].isin(*BASE))
        return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    spans = written(listed.select("text_key", some(True).alias("base"), some(False).alias("terms")), "pii_by_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_or_empty(text_col)).alias("text_key")).join(small(spans, KEYS), "text_key", "left")
    return rows.select("doc_id", "text_key", *[F.coalesce(c, F.array().cast(_SPAN)).alias(c) for c in ("base", "terms")])


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs, in whose text every span is replaced by <kind>; a span that begins inside an earlier one is part of it.

    A null text stays null. A column named text_key is kept as it is.
    """
    _, spans = found_spans(docs, text_col)
    before = Window.partitionBy("text_key").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0))).filter(F.col("start") >= F.col("from"))
    own = written(outer.groupBy(F.col("text_key").alias("pii_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("pii_spans")), "pii_outer")
    text = F.col(text_col)
    cut = lambda a, n: F.substring(text, a.cast("int") + 1, n.cast("int"))
    pieces = F.transform("pii_spans", lambda s: F.concat(cut(s["from"], s["start"] - s["from"]), F.lit("<"), s["kind"], F.lit(">")))
    last = F.element_at("pii_spans", -1)["end"]
    done = F.when(F.col("pii_spans").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), cut(last, F.length(text))))
    joined = docs.join(small(own, KEYS), F.md5(text_or_empty(text_col)) == own["pii_key"], "left")
    return joined.withColumn(text_col, done).select(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protected(table(spark, sf_dir, "documents"))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(spans, kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count("base", k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "terms")).alias("spans"), count("terms", "secret"), count("terms", "term"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans"))


QUERIES = {"op8_pii": op8_pii}
SQL: dict[str, str] = {}
