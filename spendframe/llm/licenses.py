"""Licence scan with a generalised suffix automaton over the words of licence templates.

A text's words stream through the automaton, which gives at each word the longest suffix read so far that
stands in some template (matching statistics). Maximal matches become anchors; anchors of one template
that lie close together and in the same order in text and template are chained into a span, whose
coverage is the share of the template's words that its matches cover.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spendframe.llm.common import texts, word_blocks

# Phrases whose every occurrence is reported, with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Public licence notices, as words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

SHORTEST_MATCH = 3
LARGEST_GAP = 8
LEAST_COVERAGE = 0.8

WORD_BYTES = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20
    for byte in range(256)
)

RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_phrases", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("phrase_labels", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))),
        ("score", pa.float64()),
    ]
)
RESULT_DDL = "n_words long, n_phrases long, first_word long, last_word long, phrase_labels array<string>, spans array<struct<label:string,first:long,end:long,coverage:double>>, score double"


class Automaton:
    """Generalised suffix automaton of word sequences, with the places of each state's words."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for position, symbol in enumerate(sequence):
                last = self._extend(last, symbol, ends)
                ends[last].append((number, position + 1))
        self.places = ends
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]].extend(ends[state])
        self.places = [sorted(set(found)) for found in ends]

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _clone(self, of: int, length: int, before: int, symbol: int, ends: list) -> int:
        copy = self._state(length, ends)
        self.next[copy] = dict(self.next[of])
        self.link[copy], self.link[of] = self.link[of], copy
        while before >= 0 and self.next[before].get(symbol) == of:
            self.next[before][symbol] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, symbol: int, ends: list) -> int:
        target = self.next[last].get(symbol)
        if target is not None:
            if self.length[target] == self.length[last] + 1:
                return target
            return self._clone(target, self.length[last] + 1, last, symbol, ends)
        new, before = self._state(self.length[last] + 1, ends), last
        while before >= 0 and symbol not in self.next[before]:
            self.next[before][symbol] = new
            before = self.link[before]
        if before >= 0:
            target = self.next[before][symbol]
            fits = self.length[target] == self.length[before] + 1
            self.link[new] = target if fits else self._clone(target, self.length[before] + 1, before, symbol, ends)
        return new

    def walk(self, sequence: list[int]) -> int:
        state = 0
        for symbol in sequence:
            state = self.next[state][symbol]
        return state

    def above(self, state: int) -> list[int]:
        """The state and those of its suffixes."""
        found = []
        while state > 0:
            found.append(state)
            state = self.link[state]
        return found


class Scanner:
    """Scans texts for templates (label, words) and phrases (words, label)."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates] + [label for _, label in phrases]
        sequences = [text.split() for _, text in templates] + [text.split() for text, _ in phrases]
        self.sizes = [len(sequence) for sequence in sequences]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(word.encode(), len(self.ids)) for word in sequence] for sequence in sequences]
        self.automaton = Automaton(coded)
        holds = {}
        for sequence, (_, label) in zip(coded[len(templates) :], phrases):
            holds.setdefault(self.automaton.walk(sequence), []).append((len(sequence), label))
        self.phrases = [[phrase for up in self.automaton.above(state) for phrase in holds.get(up, [])] for state in range(len(self.automaton.next))]
        self.shortest = min([SHORTEST_MATCH, *(len(text.split()) for text, _ in phrases)])

    def scan(self, text: bytes) -> dict:
        count, places, labels, matches = 0, [0, None, None], set(), []
        state = length = 0
        at = -1  # the word that the state stands at
        for words in word_blocks(text.translate(WORD_BYTES)):
            ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
            known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
            edges = np.flatnonzero(np.diff(known))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
                joined = start == 0 and at == count - 1
                if stop - start < self.shortest and not joined and stop < len(words):
                    continue
                if not joined:
                    self._end(matches, at, state, length)
                    state = length = 0
                state, length = self._run(ids[start:stop].tolist(), count + start, state, length, matches, places, labels)
                at = count + stop - 1
            count += len(words)
        self._end(matches, at, state, length)
        spans, best = self._spans(matches)
        return {
            "n_words": count,
            "n_phrases": places[0],
            "first_word": places[1],
            "last_word": places[2],
            "phrase_labels": sorted(labels),
            "spans": spans,
            "score": 1.0 if places[0] else best,
        }

    @staticmethod
    def _end(matches, at, state, length):
        if length >= SHORTEST_MATCH:
            matches.append((at - length + 1, length, state))

    def _run(self, symbols, first, state, length, matches, places, labels):
        """Reads words that all occur in templates; `first` is the number of the first of them."""
        following, link, longest, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        for at, symbol in enumerate(symbols, first):
            target = following[state].get(symbol)
            if target is None:
                self._end(matches, at - 1, state, length)
                while target is None and state > 0:
                    state = link[state]
                    target = following[state].get(symbol)
                length = longest[state]
            state, length = target, length + 1
            for size, label in phrases[state]:
                if size <= length:
                    places[0] += 1
                    places[1] = at - size + 1 if places[1] is None else min(places[1], at - size + 1)
                    places[2] = at - size + 1 if places[2] is None else max(places[2], at - size + 1)
                    labels.add(label)
        return state, length

    def _spans(self, matches) -> tuple[list[dict], float]:
        """Spans of well covered templates, the better one where two overlap, and the best coverage of all."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, state in matches:
            for template, end in self.automaton.places[state]:
                anchors.setdefault(template, []).append((start, end - length, length))
        chains, best = [], 0.0
        for template, found in anchors.items():
            for covered, first, end in self._chains(sorted(found), self.sizes[template]):
                share = covered / self.sizes[template]
                best = max(best, share)
                if share >= LEAST_COVERAGE:
                    chains.append((-covered, first, end, template, share))
        chosen, taken = [], []
        for _, first, end, template, share in sorted(chains):
            if not _overlaps(taken, first, end):
                chosen.append({"label": self.labels[template], "first": first, "end": end, "coverage": share})
                _insert(taken, first, end)
        return sorted(chosen, key=lambda span: (span["first"], span["label"])), min(best, 1.0)

    @staticmethod
    def _chains(anchors, size):
        """(covered words, first, end) of the best chain that ends at each last anchor."""
        states, low, extended = [], 0, set()
        for number, (start, at, length) in enumerate(anchors):
            covered, first, before = length, start, None
            while low < number and anchors[low][0] < start - size - LARGEST_GAP:
                low += 1
            for other in range(low, number):
                o_start, o_at, o_length = anchors[other]
                overlap = max(0, o_start + o_length - start, o_at + o_length - at)
                if o_start < start and o_at < at and overlap < length and max(start - o_start - o_length, at - o_at - o_length) <= LARGEST_GAP:
                    if states[other][0] + length - overlap > covered:
                        covered, first, before = states[other][0] + length - overlap, states[other][1], other
            states.append((covered, first, start + length))
            if before is not None:
                extended.add(before)
        return [state for number, state in enumerate(states) if number not in extended]


def _overlaps(taken: list[tuple[int, int]], first: int, end: int) -> bool:
    from bisect import bisect_left

    at = bisect_left(taken, (first, first))
    return any(a < end and first < b for a, b in taken[max(0, at - 1) : at + 1])


def _insert(taken: list[tuple[int, int]], first: int, end: int) -> None:
    from bisect import insort

    insort(taken, (first, end))


def scan(docs: DataFrame, text: str = "text", result: str = "licenses", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Adds a struct: word count, places of the phrases, labels of both kinds, covered spans and a score.

    Words are numbered from 0; `first` and `end` of a span are words, the end excluded. The score is the
    best coverage of any template, 1 where a phrase stands. Null and empty texts have no words, no labels
    and score 0; long texts are read in blocks. All rows, repeated ones too, and other columns stay; a column that
    already has the result's name is replaced. An empty table stays empty.
    """

    @arrow_udf(RESULT_DDL)
    def run(column: pa.Array) -> pa.Array:
        own = Scanner(templates, phrases)
        return pa.array([own.scan(value) for value in texts(column)], RESULT)

    return docs.withColumn(result, run(F.col(text)))
