"""License scans with a generalised suffix automaton of licence words.

The automaton holds all substrings of the templates. Streaming a text through it gives
the matching statistics: for each word the longest match that ends there. Matches that
cannot be extended and are long enough are chained per template where both text and
template go on, which gives the covered spans. Base phrases are found as the matches
that end with the whole phrase.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtally.llm.wordbytes import Words, blocks, utf8

# The phrases whose places are counted, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Short notices as the licences themselves give them.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
LEAST_MATCH = 3
MOST_GAP = 6
LEAST_COVERAGE = 0.75

SPAN = "struct<label:string,start:bigint,end:bigint,coverage:double>"
PLACE = "struct<label:string,start:bigint>"


class Automaton:
    """States of all substrings of the templates, over numbers of words."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.phrases = [(label, len(text.split())) for text, label in phrases]
        lists = [text.split() for text in [text for _, text in templates] + [text for text, _ in phrases]]
        self.vocabulary = sorted({word for words in lists for word in words})
        number = {word: i for i, word in enumerate(self.vocabulary)}
        self.sizes = [len(words) for words in lists]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, set[int]]] = [{}]
        for template, words in enumerate(lists):
            state = 0
            for place, word in enumerate(words):
                state = self._extend(state, number[word], ends)
                ends[state].setdefault(template, set()).add(place)
        # A state's string is a suffix of those whose links lead to it.
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = ends[self.link[state]]
            for template, places in ends[state].items():
                up.setdefault(template, set()).update(places)
        self.places = [
            {t: sorted(places) for t, places in found.items() if t < len(self.labels)} for found in ends
        ]
        self.least = min([LEAST_MATCH, *[size for _, size in self.phrases]])
        whole: list[list[int]] = [[] for _ in self.length]
        for phrase in range(len(phrases)):
            state = 0
            for word in lists[len(templates) + phrase]:
                state = self.next[state][number[word]]
            whole[state].append(phrase)
        self.ending: list[tuple[int, ...]] = [()] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.ending[state] = (*whole[state], *self.ending[self.link[state]])
        hashes = Words([word.encode() for word in self.vocabulary], "plain").hashes()
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order

    def _new(self, length: int, following: dict[int, int], link: int, ends: list[dict[int, set[int]]]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int, ends: list[dict[int, set[int]]]) -> int:
        """The state for the match of ``state`` and ``word`` alone, cut out of ``target``."""
        if self.length[target] == self.length[state] + 1:
            return target
        short = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target], ends)
        self.link[target] = short
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = short
            state = self.link[state]
        return short

    def _extend(self, last: int, word: int, ends: list[dict[int, set[int]]]) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word], ends)
        state = self._new(self.length[last] + 1, {}, 0, ends)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word, self.next[last][word], ends)
        return state

    def scan(self, words: np.ndarray, first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places ``(phrase, start)`` and maximal matches ``(start, length, state)``
        in a run of known words that begins at place ``first``."""
        places, matches = [], []
        state = length = before = last = 0
        for at, word in enumerate(words.tolist(), first):
            last, before = state, length
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            target = self.next[state].get(word)
            if target is not None:
                state, length = target, length + 1
            if length != before + 1 and before >= LEAST_MATCH:
                matches.append((at - before, before, last))
            for phrase in self.ending[state]:
                size = self.phrases[phrase][1]
                if length >= size:
                    places.append((phrase, at - size + 1))
        if length >= LEAST_MATCH:
            matches.append((first + len(words) - length, length, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches that go on in a template, as ``(label, start, end, coverage)``.

        Of the places where a match ends in a template, a chain goes on at the first one
        after the place it reached, and a new chain begins at the first of all.
        """
        chains: dict[int, tuple[int, int, int, int]] = {}
        found = []

        def close(template: int) -> None:
            start, end, _, covered = chains.pop(template)
            coverage = covered / self.sizes[template]
            if coverage >= LEAST_COVERAGE:
                found.append((self.labels[template], start, end, min(coverage, 1.0)))

        for start, length, state in matches:
            for template, places in self.places[state].items():
                if template in chains:
                    begin, end, reached, covered = chains[template]
                    later = bisect_right(places, reached)
                    if start + length - end <= MOST_GAP + length and later < len(places):
                        new = min(length, places[later] - reached, start + length - end)
                        chains[template] = (begin, start + length, places[later], covered + max(new, 0))
                        continue
                    close(template)
                chains[template] = (start, start + length, places[0], length)
        for template in list(chains):
            close(template)
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))


def _scan_texts(automaton: Automaton, texts: list[bytes]) -> list[tuple]:
    """``(n_words, places, spans)`` for each text."""
    words = Words(texts, "plain")
    hashes = words.hashes()
    slot = np.minimum(np.searchsorted(automaton.hashes, hashes), len(automaton.hashes) - 1)
    known = automaton.hashes[slot] == hashes if len(hashes) else np.zeros(0, dtype=bool)
    number = automaton.numbers[slot]
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(words.counts, out=first[1:])
    # Runs of known words; a run ends with its text.
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (words.text[1:] != words.text[:-1])
    starts = np.flatnonzero(begins)
    ends_ = known.copy()
    ends_[:-1] &= ~known[1:] | (words.text[1:] != words.text[:-1])
    ends = np.flatnonzero(ends_) + 1
    long = ends - starts >= automaton.least
    places: dict[int, list] = {}
    matches: dict[int, list] = {}
    for low, high in zip(starts[long].tolist(), ends[long].tolist()):
        text = int(words.text[low])
        found, maximal = automaton.scan(number[low:high], low - int(first[text]))
        if found:
            places.setdefault(text, []).extend(found)
        if maximal:
            matches.setdefault(text, []).extend(maximal)
    out = []
    for text, count in enumerate(words.counts.tolist()):
        spans = automaton.spans(matches[text]) if text in matches else []
        named = [(automaton.phrases[p][0], start) for p, start in places.get(text, [])]
        out.append((count, named, spans))
    return out


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """``doc_id, n_words, places, spans`` for each row of ``docs``.

    ``places`` lists every base phrase with its first word, ``spans`` the stretches that
    cover at least LEAST_COVERAGE of a template. Null and empty texts have no words;
    repeated rows are scanned each. Templates are given lower-cased, words apart.
    """
    automaton = Automaton(templates, phrases)
    given = docs.select("doc_id", F.col("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, places array<{PLACE}>, spans array<{SPAN}>"
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span = pa.list_(
        pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            rows = [row for low, high in blocks(texts) for row in _scan_texts(automaton, texts[low:high])]
            arrays = [
                batch.column(0),
                pa.array([row[0] for row in rows], pa.int64()),
                pa.array([[{"label": a, "start": b} for a, b in row[1]] for row in rows], place),
                pa.array(
                    [[{"label": a, "start": b, "end": c, "coverage": d} for a, b, c, d in row[2]] for row in rows],
                    span,
                ),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "places", "spans"])

    return given.mapInArrow(scan, schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_licenses(docs)
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    method = F.transform("spans", lambda s: s["label"])
    coverage = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, method))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(coverage).alias("score"),
        "spans",
    )
