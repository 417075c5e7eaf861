"""License scans by template markup.

A template is wording with two kinds of markup: ``<<optional>> ... <<end>>``
around words that may be left out, and ``<<var N>>`` for up to N words of any
kind. It is compiled into an automaton over tokens; a place in a text is
accepted when all mandatory wording is there, word for word and in order. There
are notices and whole licences, whose replaceable regions are the parts that
holders fill in. A text is tokenized only if it holds a chosen mandatory word of
some template or phrase; the automata themselves tell which words are mandatory.

Rows: null and empty texts have no words, labels are then empty strings and the
score is 0. Repeated rows are scanned like any others. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import runtime, text

#: Base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Wording of common notices, in this module's markup.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license <<optional>> version <<end>> 2 0",
        "licensed under the apache license version 2 0 <<optional>> the license <<end>> you may not use this file except in compliance with the license",
    ],
    "mit": [
        "<<optional>> released <<end>> <<optional>> licensed <<end>> <<optional>> distributed <<end>> under the <<optional>> terms of the <<end>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "under the terms of the gnu general public license as published by the free software foundation <<optional>> either <<end>> version 3 <<optional>> of the license <<end>>",
    ],
    "gpl-2.0": ["under the terms of the gnu general public license as published by the free software foundation <<optional>> either <<end>> version 2 <<optional>> of the license <<end>>"],
    "cc-by-nc-4.0": ["licensed under <<optional>> a <<end>> <<optional>> creative commons <<end>> cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "cc-by-4.0": ["licensed under <<optional>> a <<end>> <<optional>> creative commons <<end>> cc by 4 0", "creative commons attribution 4 0 international"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall <<var 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc-text": [
        "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<var 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "bsd-2-clause-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by <<var 20>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<var 20>> be liable for any direct indirect incidental special exemplary or consequential damages",
    ],
    "bsd-3-clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var 120>> neither the name of <<var 12>> nor the names of its contributors may be used"],
    "isc": ["permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted"],
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """Token automaton of one template; states are numbered along the wording."""

    label: str
    steps: list[dict[bytes, set[int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)  # moves without a token
    wild: list[set[int]] = field(default_factory=list)  # moves on any token
    final: int = 0

    def state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        self.wild.append(set())
        return len(self.steps) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def mandatory(self) -> list[bytes]:
        """Words without which the automaton accepts nothing."""
        words = {w for d in self.steps for w in d}
        return [w for w in words if self.final not in self.reachable(w)]

    def reachable(self, without: bytes) -> set[int]:
        """States that can be reached if one word never comes."""
        seen = todo = {0}
        while todo:
            todo = {t for s in todo for t in self.free[s] | self.wild[s] | {t for w, to in self.steps[s].items() if w != without for t in to}} - seen
            seen = seen | todo
        return seen

    def starts(self) -> set[bytes]:
        """Tokens that can begin an accepted place."""
        return {w for s in self.reach({0}) for w in self.steps[s]}

    def accept(self, tokens: list[bytes], at: int) -> int:
        """Tokens of the longest accepted place that starts at ``at``; 0 if there is none."""
        now, best, i = self.reach({0}), 0, at
        while now and i < len(tokens):
            now = self.reach({t for s in now for t in self.steps[s].get(tokens[i], set()) | self.wild[s]})
            i += 1
            if self.final in now:
                best = i - at
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of one template."""
    a = Automaton(label)
    at, opened = a.state(), []
    for piece in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if piece == "<<optional>>":
            opened.append(at)
        elif piece == "<<end>>":
            a.free[opened.pop()].add(at)
        elif piece.startswith("<<var"):
            begin = at
            for _ in range(int(piece[5:-2])):
                to = a.state()
                a.wild[at].add(to)
                a.free[at].add(begin + int(piece[5:-2]))
                at = to
        else:
            to = a.state()
            a.steps[at].setdefault(piece.lower().encode(), set()).add(to)
            at = to
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    a.final = at
    return a


@cache
def automata() -> list[Automaton]:
    return [compile_template(k, t) for k, all_of in TEMPLATES.items() for t in all_of]


@cache
def _plan() -> tuple[dict[bytes, list], list[bytes], list[tuple[list[bytes], str]]]:
    """By first token the automata; parts of words one of which every match holds; base phrases."""
    by = {}
    for a in automata():
        for w in a.starts():
            by.setdefault(w, []).append(a)
    phrases = [(p.encode().split(), v) for p, v in PHRASES.items()]
    rare = {max(p, key=lambda w: (len(w), w)) for p, _ in phrases}
    for a in automata():
        words = a.mandatory()
        if not any(w in v for w in rare for v in words):
            # A template without a mandatory word would have to be tried on every text: the empty word is in each.
            rare.add(max(words, key=lambda w: (len(w), w), default=b""))
    return by, sorted(rare), phrases


def scan(low: bytes) -> dict:
    """Base places and labels of one lower-cased text."""
    by, rare, phrases = _plan()
    none = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "places": []}
    if not any(k in low for k in rare):
        return none
    tokens = _WORD.findall(low)
    places, base, found, spans = [], set(), set(), []
    heads = {p[0][0] for p in phrases}
    for i, w in enumerate(tokens):
        if w in heads:
            for p, label in phrases:
                if tokens[i : i + len(p)] == p:
                    places.append(i)
                    base.add(label)
        for a in by.get(w, ()):
            if n := a.accept(tokens, i):
                found.add(a.label)
                spans.append((i, n, a.label))
    if not places and not found:
        return none
    return {
        "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | found)), "score": 1.0 if found else 0.5, "places": spans,
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()
    for b in batches:
        for lo, hi, buf, offs in text.doc_slices(b["text"]):
            low = text.LOWER[buf]
            counts = np.diff(text.words(low, offs, text.ALNUM).first)
            raw = low.tobytes()
            rows = [scan(raw[offs[i] : offs[i + 1]]) for i in range(hi - lo)]
            yield runtime.out_batch(schema, doc_id=b["doc_id"].slice(lo, hi - lo), n_words=counts, **{k: [r[k] for r in rows] for k in schema.names[2:]})


def license_scan(documents: DataFrame) -> DataFrame:
    """Base places, labels of phrases and of accepted templates, for each document.

    One narrow pass: nothing is shuffled. A score is 1 if a template accepts, 0.5
    if there are base phrases only, else 0.
    """
    runtime.arrow_limits(documents.sparkSession)
    return runtime.need(documents, "doc_id", "text").mapInArrow(runtime.lean(scan_batches), SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(runtime.table(spark, sf_dir, "documents"))


def template_pattern(markup: str) -> str:
    """The template as a regular expression over words that have one blank before each."""
    out = ""
    for piece in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if piece == "<<optional>>":
            out += "(?:"
        elif piece == "<<end>>":
            out += ")?"
        elif piece.startswith("<<var"):
            out += "(?: [^ ]+){0,%d}" % int(piece[5:-2])
        else:
            out += " " + piece.lower()
    return out + " "


def _sql() -> str:
    """The scan in SQL, made from the same phrases and templates."""
    places = " OR ".join(" AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p in PHRASES)
    base = ", ".join(f"CASE WHEN contains(t, ' {p} ') THEN '{v}' END" for p, v in PHRASES.items())
    more = ", ".join(f"CASE WHEN regexp_matches(t, '{template_pattern(m)}') THEN '{k}' END" for k, all_of in TEMPLATES.items() for m in all_of)
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ',')"
    return rf"""
    WITH w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
    ),
    p AS (SELECT doc_id, len(w) AS n_words, list_filter(range(1, len(w) + 1), lambda i: {places}) AS places, ' ' || array_to_string(w, ' ') || ' ' AS t FROM w),
    l AS (SELECT doc_id, n_words, places, [{base}] AS b, [{more}] AS m FROM p)
    SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
      coalesce({joined("b")}, '') AS base_labels, coalesce({joined("list_concat(b, m)")}, '') AS labels,
      CAST(CASE WHEN len(list_filter(m, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
    FROM l
    """


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE_SQL = {"op10_license_scan": _sql()}
