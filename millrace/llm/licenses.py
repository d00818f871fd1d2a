"""License scans on a generalised suffix automaton of template tokens.

Every text is streamed through the automaton once; at each word it knows the longest suffix that occurs in any
template (matching statistics). A phrase stands where that suffix ends with it. A match counts at every place where
its words stand in the templates; matches are chained in template order, the best chain by the words of the template
that it covers, into spans whose covered share is the score.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import ALNUM, sequences

#: Phrases whose every place counts, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Longer templates; their spans give the label with "-text".
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}
#: Words of a match that may join a chain, and the covered share of a template that gives its label.
LEAST_MATCH, LEAST_COVER = 4, 0.6


class Automaton:
    """Suffix automaton of several token sequences: next, link and len by state, and the places where each state ends."""

    def __init__(self, sequences_: list[list[int]]):
        self.next, self.link, self.len = [{}], [-1], [0]
        ends: dict[int, set[tuple[int, int]]] = {}
        for s, tokens in enumerate(sequences_):
            last = 0
            for i, t in enumerate(tokens):
                last = self._extend(last, t)
                ends.setdefault(last, set()).add((s, i + 1))
        # A state ends where its longer states do.
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            ends.setdefault(self.link[s], set()).update(ends.get(s, ()))
        self.ends = [sorted(ends.get(s, ())) for s in range(len(self.len))]

    def _new(self, n: int, nxt: dict | None = None, link: int = 0) -> int:
        self.next.append(nxt or {})
        self.link.append(link)
        self.len.append(n)
        return len(self.len) - 1

    def _split(self, p: int, t: int) -> int:
        q = self.next[p][t]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            return self._split(last, t)
        now = self._new(self.len[last] + 1)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = now
            p = self.link[p]
        self.link[now] = self._split(p, t) if p >= 0 else 0
        return now

    def step(self, state: int, n: int, t: int) -> tuple[int, int]:
        while state and t not in self.next[state]:
            state = self.link[state]
            n = self.len[state]
        return (self.next[state][t], n + 1) if t in self.next[state] else (0, 0)


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        hashed = lambda text: next(sequences([text], ALNUM)).tolist()
        self.phrases = [(hashed(p), label) for p, label in phrases.items()]
        self.templates = [(label, hashed(t)) for label, t in templates.items()]
        self.sam = Automaton([t for _, t in self.templates] + [p for p, _ in self.phrases])
        self.words = np.array(sorted(self.sam.next[0]), np.uint64)
        ends: dict[int, list[int]] = {}
        for k, (p, _) in enumerate(self.phrases):
            state = 0
            for t in p:
                state = self.sam.next[state][t]
            ends.setdefault(state, []).append(k)
        # The phrases that end each state: its own and those of its suffixes.
        self.phrase_ends: list[list[int]] = [[] for _ in self.sam.len]
        for s in sorted(range(1, len(self.sam.len)), key=self.sam.len.__getitem__):
            self.phrase_ends[s] = ends.get(s, []) + self.phrase_ends[self.sam.link[s]]

    def scan(self, text: str | None):
        return self.scan_words(next(sequences([text], ALNUM)))

    def scan_words(self, words: np.ndarray):
        """n_words, [(start, phrase)], [(label, start, end, covered share)] of the hashes of a whole text's words."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        places = np.flatnonzero(self.words[at] == words) if len(self.words) else np.empty(0, int)
        sam, base, matches = self.sam, [], {}
        state, n, before = 0, 0, -2
        for i, w in zip(places.tolist(), words[places].tolist(), strict=True):
            if i != before + 1:
                self._keep(matches, state, n, before)
                state, n = 0, 0
            after = sam.step(state, n, w)
            if after[1] <= n:
                self._keep(matches, state, n, before)
            (state, n), before = after, i
            for k in self.phrase_ends[state]:
                if n >= len(self.phrases[k][0]):
                    base.append((i - len(self.phrases[k][0]) + 1, k))
        self._keep(matches, state, n, before)
        return len(words), base, sorted((x for s, found in matches.items() for x in self._spans(s, found)), key=lambda x: (x[1], x[2], x[0]))

    def _keep(self, matches: dict, state: int, n: int, end: int) -> None:
        """The match of n words that ends the text's word `end`, at all its places in templates."""
        if n >= LEAST_MATCH:
            for s, at in self.sam.ends[state]:
                if s < len(self.templates):
                    matches.setdefault(s, []).append((end - n + 1, end + 1, at - n, at))

    def _spans(self, s: int, found: list) -> Iterator[tuple[str, int, int, float]]:
        """Chains of matches of template s, none farther apart than the template is long."""
        tokens, cluster = self.templates[s][1], []
        for m in [*sorted(found), None]:
            if cluster and (m is None or m[0] - max(x[1] for x in cluster[-64:]) > len(tokens)):
                yield from self._best(s, cluster)
                cluster = []
            if m:
                cluster.append(m)

    def _best(self, s: int, found: list) -> Iterator[tuple[str, int, int, float]]:
        """Spans of the chains that cover enough of the template, the largest first, and then what is left between them."""
        label, tokens = self.templates[s]
        todo = [found]
        while todo:
            own = todo.pop()
            if sum(m[3] - m[2] for m in own) < LEAST_COVER * len(tokens):
                continue
            score, back = self._scores(own, len(tokens))
            spans: list[tuple[int, int]] = []
            for j in sorted(range(len(own)), key=lambda j: (-score[j], j)):
                if score[j] < LEAST_COVER * len(tokens):
                    break
                first = j
                while back[first] >= 0:
                    first = back[first]
                start, end = own[first][0], own[j][1]
                at = bisect.bisect(spans, (start, end))
                if (at == 0 or spans[at - 1][1] <= start) and (at == len(spans) or spans[at][0] >= end):
                    spans.insert(at, (start, end))
                    yield label, start, end, min(1.0, score[j] / len(tokens))
            if spans:
                for after, before in zip([own[0][0], *(e for _, e in spans)], [*(b for b, _ in spans), max(m[1] for m in own)], strict=True):
                    if rest := [m for m in own if m[0] >= after and m[1] <= before]:
                        todo.append(rest)

    @staticmethod
    def _scores(found: list, length: int) -> tuple[list[int], list[int]]:
        """For each match the words that the best chain ending with it covers, and the match before it in that chain.

        Matches of a chain go forward in text and template; where two overlap, the later one counts from where both
        are free. They are in the order of the text, so only those within a template's length are looked at.
        """
        score, back, lowest = [], [], 0
        for j, (a, b, p, q) in enumerate(found):
            while found[lowest][0] < a - 2 * length:
                lowest += 1
            score.append(q - p)
            back.append(-1)
            for i in range(lowest, j):
                a2, b2, p2, q2 = found[i]
                more = min(q - max(p, q2), b - max(a, b2))
                if a2 < a and p2 < p and b2 < b and q2 < q and b2 >= a - length and score[i] + more > score[j]:
                    score[j], back[j] = score[i] + more, i
        return score, back


def licensed(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """All columns of docs with license: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null and empty texts have no words and score 0. Whole texts are scanned; repeated rows get equal results; an
    empty table gives an empty result. A column named license is replaced. spans are (label, start, end, share).
    Words are known by 64-bit hashes.
    """
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>"
    arrow = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])))])
    scanner = Scanner(phrases, templates)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for words in sequences(texts, ALNUM):
                n, base, spans = scanner.scan_words(words)
                starts, own = [i for i, _ in base], {scanner.phrases[k][1] for _, k in base}
                score = 1.0 if base else max([0.0, *(x[3] for x in spans)])
                out.append({"n_words": n, "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x[0] for x in spans})), "score": score, "spans": [dict(zip(("label", "start", "end", "share"), x, strict=True)) for x in spans]})
            yield pa.array(out, arrow)

    return docs.withColumn("license", F.arrow_udf(run, kind)("text"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licensed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


QUERIES = {"op1_licenses": op1_licenses}
SQL: dict[str, str] = {}
