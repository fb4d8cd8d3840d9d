"""License scans (operator 9): template-markup matching.

A template is license wording with two kinds of markup:

    <<beginOptional>> ... <<endOptional>>   wording that may be missing
    <<var;n>>                               1 to n words of any kind

Templates are compiled to one automaton on word tokens: mandatory words must
match exactly, optional regions may be skipped, replaceable regions take any
words up to their number. A template is accepted at a place if it matches from
there; the longest match counts. The state sets of the automaton are made into
deterministic steps as they are met, and kept.

Words are lower-cased (A-Z) runs of digits, letters and all code points beyond
ASCII. A slice of texts is tokenised without an object per word; the
automaton only starts where the next two words can begin a template, which is
looked up for all words at once.

Base templates are plain phrases; all their places count (n_base, first_word,
last_word, base_labels). Further templates add labels. The score is
1 - 1 / (1 + mandatory words of the longest template accepted), 0 if none is.

Defined results: null and empty texts have no words, empty labels, null places
and score 0. Other columns pass through, and columns of the input named like
the added ones are replaced. Templates need two mandatory words at the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parityframe.llm import wordhash as wh
from parityframe.llm.common import read_table, ship

_SEPARATORS = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
_IS_WORD = wh.word_table(_SEPARATORS)
_LANE = wh.lane(91, _SEPARATORS, lower=True)
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;\d+)>>")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Template(NamedTuple):
    label: str
    wording: str
    base: bool = False


# Public license wordings and the three base phrases.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit-notice", "Released under the MIT License"),
    Template("mit-notice", "Licensed under the MIT License"),
    Template("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the
        next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software."""),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", """Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License"""),
    Template("gpl-3.0", """licensed under the <<beginOptional>>terms of the<<endOptional>>
        <<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"""),
    Template("gpl-2.0", """licensed under the <<beginOptional>>terms of the<<endOptional>>
        <<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"""),
    Template("gpl-text", """is free software <<beginOptional>>you can<<endOptional>> redistribute it and/or modify it
        under the terms of the GNU General Public License as published by the Free Software Foundation"""),
    Template("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA 4.0"),
    Template("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY 4.0"),
    Template("cc-by", "Creative Commons Attribution <<var;3>> <<beginOptional>>International<<endOptional>> License"),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer"""),
    Template("bsd-3", """Neither the name of <<var;12>> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission"""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies"""),
    Template("mpl-2.0", """subject to the terms of the Mozilla Public License <<beginOptional>>v<<endOptional>> 2.0"""),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Automaton:
    """All templates as one automaton on token numbers; 0 is any other word."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.token: dict[bytes, int] = {}
        # Per state: (token or None for any word, next state), and empty steps.
        self.on: list[tuple[int | None, int] | None] = []
        self.empty: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.size = []
        starts = []
        for number, template in enumerate(templates):
            start, end, mandatory = self._compile(template.wording)
            starts.append(start)
            self.accepts[end] = number
            self.size.append(mandatory)
        self.steps: dict[tuple[frozenset, int], frozenset] = {}
        self.begin = self._closed(starts)
        self.first_two = self._first_two()

    def _state(self) -> int:
        self.on.append(None)
        self.empty.append([])
        return len(self.on) - 1

    def _compile(self, wording: str) -> tuple[int, int, int]:
        start = at = self._state()
        open_, mandatory = [], 0
        for i, part in enumerate(_MARKUP.split(wording)):
            if i % 2 == 0:
                for word in words_of(part):
                    to = self._state()
                    self.on[at] = (self.token.setdefault(word, len(self.token) + 1), to)
                    at = to
                    mandatory += not open_
            elif part == "beginOptional":
                open_.append(at)
            elif part == "endOptional":
                # A state of its own, so that a next region can't undo this one.
                to = self._state()
                self.empty[at].append(to)
                self.empty[open_.pop()].append(to)
                at = to
            else:
                end = self._state()
                for _ in range(int(part[4:])):
                    to = self._state()
                    self.on[at] = (None, to)
                    self.empty[to].append(end)
                    at = to
                at = end
        if open_:
            raise ValueError("a template's optional region has no end")
        return start, at, mandatory

    def _closed(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, states: frozenset, token: int) -> frozenset:
        key = (states, token)
        if key not in self.steps:
            after = [self.on[s][1] for s in states if self.on[s] and self.on[s][0] in (None, token)]
            self.steps[key] = self._closed(after)
        return self.steps[key]

    def _first_two(self) -> set[tuple[int, int]]:
        found = set()
        for s in self.begin:
            a, to = self.on[s]
            for t in self._closed([to]):
                b = self.on[t] and self.on[t][0]
                if a is None or not b:
                    raise ValueError("a template needs two words at its start")
                found.add((a, b))
        return found

    def run(self, tokens: list[int], at: int, end: int) -> list[int]:
        """Numbers of the templates that match from ``at``."""
        states, found = self.begin, []
        while at < end and states:
            states = self.step(states, tokens[at])
            found += [self.accepts[s] for s in states if s in self.accepts]
            at += 1
        return found


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
                      T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
                      T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
                      T.StructField("score", T.DoubleType())])
_BITS = 16


class Scanner:
    """The automaton with what finds its starting places in word hashes."""

    def __init__(self, templates: tuple[Template, ...]):
        self.automaton = Automaton(templates)
        vocabulary = list(self.automaton.token)
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        offsets = np.r_[0, np.cumsum([len(w) for w in vocabulary])]
        h = wh.word_hashes(wh.Words(data, offsets[:-1], offsets[1:], offsets), _LANE)
        order = np.argsort(h)
        self.hashes, self.numbers = h[order], np.array([self.automaton.token[w] for w in vocabulary])[order]
        # Most words are none of the vocabulary, which some bits of the hash tell.
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[self.hashes >> np.uint64(64 - _BITS)] = True
        n = len(vocabulary) + 1
        self.pairs = np.zeros((n, n), dtype=bool)
        for pair in self.automaton.first_two:
            self.pairs[pair] = True

    def tokens(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int32)
        near = np.flatnonzero(self.maybe[h >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        same = self.hashes[at] == h[near]
        out[near[same]] = self.numbers[at[same]]
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """A row of ADDED for every text of a slice."""
        words = wh.find_words(data, offsets, _IS_WORD)
        tokens = self.tokens(wh.word_hashes(words, _LANE))
        starts = np.flatnonzero(self.pairs[tokens[:-1], tokens[1:]]) if len(tokens) else np.zeros(0, np.int64)
        text_of = np.searchsorted(words.first, starts, "right") - 1
        rows: dict[int, list] = {}
        for at, text in zip(starts.tolist(), text_of.tolist()):
            end = int(words.first[text + 1])
            # Enough words for the longest template; a var region is unrolled in its states.
            reach = tokens[at:min(end, at + len(self.automaton.on))].tolist()
            for number in self.automaton.run(reach, 0, len(reach)):
                template = self.automaton.templates[number]
                row = rows.setdefault(text, [[], set(), set(), 0])
                if template.base:
                    row[0].append(at - int(words.first[text]))
                    row[1].add(template.label)
                row[2].add(template.label)
                row[3] = max(row[3], self.automaton.size[number])
        out = []
        for text, n in enumerate(np.diff(words.first).tolist()):
            places, base, labels, size = rows.get(text, ((), (), (), 0))
            out.append((n, len(places), min(places, default=None), max(places, default=None),
                        ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 1 / (1 + size)))
        return out


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` plus the columns of ADDED."""
    ship(docs.sparkSession)
    docs = docs.drop(*ADDED.names)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + ADDED.fields)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [row for _, _, data, offsets in wh.text_slices(batch.column(text_col))
                    for row in scanner.scan(data, offsets)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.record_batch([*batch.columns, *columns], names=schema.names)
    return docs.mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", *ADDED.names)
