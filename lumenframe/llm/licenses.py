"""License scans: templates with optional and replaceable regions, compiled into one automaton over words.

Markup of a template: <<beginOptional>> ... <<endOptional>> (may be nested) is wording that may be absent,
<<var;match="...">> stands for other words: ".{lo,hi}" for so many words of any kind, "(a b|c)" for one of the
alternatives. All other words are mandatory and have to stand in the text exactly, in order, with nothing between;
case, punctuation, white space and markup of the text don't count, as words are all that is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_blocks, word_hashes

# The phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_LICENSED = '<<var;match="(licensed|released|distributed|available|published|provided)">>'
_WARRANTY = """the software is provided as is <<beginOptional>>without warranty of any kind<<endOptional>> express or implied including but not limited to
    the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var;match=".{1,20}">> be liable for any claim
    damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    <<beginOptional>><<var;match="(1|i|a)">><<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    <<beginOptional>><<var;match="(2|ii|b)">><<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
    in the documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by <<var;match=".{1,20}">> as is and any express or implied warranties including but not limited to the implied warranties of
    merchantability and fitness for a particular purpose are disclaimed"""
_FREE = """<<var;match="(this program|this file|this library|it|.{1,8})">> is free software you can redistribute it and or modify it under the terms of the
    gnu <<var;match="({kind})">> as published by the free software foundation either version {version} of the license or at your option any later version"""
_GNU = _LICENSED + ' under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>gnu<<endOptional>> <<var;match="({kind})">> <<beginOptional>>version<<endOptional>> <<var;match="({version})">>'
_CC = '<<var;match="(cc|creative commons)">> <<var;match="({kind})">> <<beginOptional>>version<<endOptional>> 4 0 <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>'


def _gnu(name: str, kind: str, versions: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for number, written in versions.items():
        out[f"{name}-{number}"] = [_GNU.format(kind=kind, version=written)]
        first = written.split("|", 1)[0]
        out[f"{name}-{number}-or-later"] = [_FREE.split(">>", 1)[1].format(kind=kind, version=first)]
    return out


#: Label to its templates. Labels are the public short identifiers of the licenses.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        _LICENSED + ' under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> mit license',
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software
        without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom
        the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>>
        shall be included in all copies or substantial portions of the software """ + _WARRANTY,
    ],
    "Apache-2.0": [
        _LICENSED + " under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0",
        """you may not use <<var;match="(this file|these files|this software|.{1,6})">> except in compliance with the license you may obtain a copy of the license at
        <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www apache org licenses license 2 0""",
    ],
    **_gnu("GPL", "general public license|gpl", {"2.0": "2|2 0", "3.0": "3|3 0"}),
    **_gnu("LGPL", "lesser general public license|library general public license|lgpl", {"2.1": "2 1", "3.0": "3|3 0"}),
    **_gnu("AGPL", "affero general public license|agpl", {"3.0": "3|3 0"}),
    "BSD-2-Clause": [f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": [
        f"""{_BSD} <<beginOptional>><<var;match="(3|iii|c)">><<endOptional>> neither the name of <<var;match=".{{1,20}}">> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission {_BSD_END}"""
    ],
    "ISC": [
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies"""
    ],
    "Zlib": [
        """permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"""
    ],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "BSL-1.0": ["boost software license <<beginOptional>>version<<endOptional>> 1 0"],
    "MPL-2.0": ["subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0", _LICENSED + " under the mozilla public license <<beginOptional>>version<<endOptional>> 2 0"],
    "EPL-2.0": ["terms of the eclipse public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"],
    "CC0-1.0": ['<<var;match="(cc0|creative commons zero)">> <<beginOptional>>v<<endOptional>> 1 0 <<beginOptional>>universal<<endOptional>>'],
    "CC-BY-4.0": [_CC.format(kind="by|attribution")],
    "CC-BY-SA-4.0": [_CC.format(kind="by sa|attribution sharealike|attribution share alike")],
    "CC-BY-NC-4.0": [_CC.format(kind="by nc|attribution noncommercial|attribution non commercial")],
    "CC-BY-ND-4.0": [_CC.format(kind="by nd|attribution noderivatives|attribution no derivatives")],
    "CC-BY-NC-SA-4.0": [_CC.format(kind="by nc sa|attribution noncommercial sharealike")],
    "CC-BY-NC-ND-4.0": [_CC.format(kind="by nc nd|attribution noncommercial noderivatives")],
    "proprietary": ['all rights reserved <<beginOptional>><<var;match=".{0,6}">><<endOptional>> <<var;match="(no part|unauthorized copying|do not distribute|confidential|proprietary)">>'],
}

#: Spellings that stand for one another in templates (not in base phrases).
EQUIVALENT = {"license": ("license", "licence"), "licensed": ("licensed", "licenced"), "sublicense": ("sublicense", "sublicence")}

_MARKUP = re.compile(r'<<(beginOptional|endOptional|var;match="([^"]*)")>>')
_ANY = re.compile(r"\.\{(\d+),(\d+)\}")


@dataclass
class Part:
    """A node of a template: a word with its spellings, an optional part, alternatives or a run of any words."""

    kind: str
    words: tuple[str, ...] = ()
    parts: list = field(default_factory=list)
    low: int = 0
    high: int = 0


def parse(template: str, equivalent: dict[str, tuple[str, ...]] = EQUIVALENT) -> list[Part]:
    """The parts of a template. A region that is not closed, or markup that is not known, is an error."""

    def plain(text: str) -> list[Part]:
        if "<<" in text or ">>" in text:
            raise ValueError(f"markup not known: {text.strip()[:60]}")
        return [Part("word", equivalent.get(w, (w,))) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())]

    stack: list[list[Part]] = [[]]
    at = 0
    for m in _MARKUP.finditer(template):
        stack[-1] += plain(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("a region ends that did not begin")
            inner = stack.pop()
            stack[-1].append(Part("optional", parts=inner))
        elif found := _ANY.fullmatch(m[2]):
            stack[-1].append(Part("any", low=int(found[1]), high=int(found[2])))
        elif m[2].startswith("(") and m[2].endswith(")"):
            options = [[Part("any", low=int(f[1]), high=int(f[2]))] if (f := _ANY.fullmatch(o)) else plain(o) for o in m[2][1:-1].split("|")]
            stack[-1].append(Part("choice", parts=options))
        else:
            raise ValueError(f"match not known: {m[2]}")
    stack[-1] += plain(template[at:])
    if len(stack) > 1:
        raise ValueError("a region is not closed")
    return stack[0]


def mandatory(parts: list[Part]) -> int:
    """Words that every text of the template has."""
    return sum(1 if p.kind == "word" else p.low if p.kind == "any" else min(mandatory(o) for o in p.parts) if p.kind == "choice" else 0 for p in parts)


def as_pattern(parts: list[Part]) -> str:
    """The same language as a regular expression over words that each are followed by a blank."""
    made = {
        "word": lambda p: f"{p.words[0]} " if len(p.words) == 1 else f"(?:{'|'.join(p.words)}) ",
        "any": lambda p: f"(?:[^ ]+ ){{{p.low},{p.high}}}",
        "choice": lambda p: f"(?:{'|'.join(as_pattern(o) for o in p.parts)})",
        "optional": lambda p: f"(?:{as_pattern(p.parts)})?",
    }
    return "".join(made[p.kind](p) for p in parts)


class Automaton:
    """Nondeterministic states of all templates, made deterministic where texts lead. Words are numbers
    from 1 (0: any word that no template has)."""

    def __init__(self, templates: list[list[Part]]):
        self.number: dict[str, int] = {}
        self.steps: list[dict[int, set[int]]] = []  # state -> word -> states; -1 is any word
        self.free: list[set[int]] = []  # states reached without a word
        self.ends: dict[int, int] = {}
        starts = set()
        for k, parts in enumerate(templates):
            if not mandatory(parts):
                raise ValueError("a template without mandatory words fits everywhere")
            first = self._state()
            starts.add(first)
            self.ends[self._chain(parts, first)] = k
        self.sets: list[frozenset[int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.of_set: dict[frozenset[int], int] = {}
        self.next: dict[tuple[int, int], int] = {}
        self.dead, self.start = self._numbered(frozenset()), self._numbered(self._closed(starts))

    def _state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def _chain(self, parts: list[Part], at: int) -> int:
        for p in parts:
            after = self._state()
            if p.kind == "word":
                for w in p.words:
                    self.steps[at].setdefault(self.number.setdefault(w, len(self.number) + 1), set()).add(after)
            elif p.kind == "any":
                for k in range(p.high):
                    if k >= p.low:
                        self.free[at].add(after)
                    on = self._state()
                    self.steps[at].setdefault(-1, set()).add(on)
                    at = on
                self.free[at].add(after)
            else:
                for option in [p.parts, []] if p.kind == "optional" else p.parts:
                    self.free[self._chain(option, at)].add(after)
            at = after
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def _numbered(self, states: frozenset[int]) -> int:
        if states not in self.of_set:
            self.of_set[states] = len(self.sets)
            self.sets.append(states)
            self.accepts.append(tuple(sorted({self.ends[s] for s in states if s in self.ends})))
        return self.of_set[states]

    def step(self, at: int, word: int) -> int:
        found = self.next.get((at, word))
        if found is None:
            reached = set()
            for s in self.sets[at]:
                reached |= self.steps[s].get(word, set()) | self.steps[s].get(-1, set())
            found = self.next[at, word] = self._numbered(self._closed(reached))
        return found

    def first_words(self) -> np.ndarray:
        """[number + 1, number + 1] table of the two words with which some template begins."""
        n = len(self.number) + 1
        out = np.zeros((n, n), bool)
        for a in range(n):
            after = self.step(self.start, a)
            if after != self.dead:
                out[a] = [bool(self.accepts[after]) or self.step(after, b) != self.dead for b in range(n)]
        return out

    def places(self, words: list[int], start: int) -> dict[int, int]:
        """Template -> where its longest match from start ends."""
        at, out = self.start, {}
        for k in range(start, len(words)):
            at = self.step(at, words[k])
            if at == self.dead:
                break
            for t in self.accepts[at]:
                out[t] = k + 1
        return out


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Deterministic states that a task keeps; beyond them it begins anew.
_MOST_STATES = 50_000


def _scan(templates: list[list[Part]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        names = list(automaton.number)
        hashes, _ = word_hashes([w.encode() for w in names])
        order = np.argsort(hashes)
        hashes, numbers = hashes[order], order + 1
        begins = automaton.first_words()
        place = pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])
        for batch in batches:
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").translate(_WORDS) for t in batch.column(1)]
            n_words, found = [], []
            for block in text_blocks(texts):
                words, cuts = word_hashes(texts[block])
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                known = np.append(np.where(hashes[at] == words, numbers[at], 0), 0)
                starts = np.flatnonzero(begins[known[:-1], known[1:]])
                bounds = np.searchsorted(starts, cuts)
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    n_words.append(b - a)
                    here = starts[bounds[k] : bounds[k + 1]] - a
                    ids = known[a:b].tolist() if len(here) else []
                    found.append([(t, s, e) for s in here.tolist() for t, e in automaton.places(ids, s).items()])
            if len(automaton.sets) > _MOST_STATES:
                automaton = Automaton(templates)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array([[dict(zip(("template", "first_word", "end_word"), f, strict=True)) for f in x] for x in found], pa.list_(place))], ["doc_id", "n_words", "places"])

    return run


def license_places(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, places(label, base, mandatory, first_word, end_word).

    A place is where a base phrase stands, or the longest match of a template from a word on; overlapping ones are all there, sorted by
    their first word. mandatory is the number of words that the template demands. Null and empty texts have no words; repeated
    rows are scanned alike; other columns are ignored; an empty table gives no rows. Words are compared by 64-bit hashes.
    """
    rows = [(label, True, parse(phrase, {})) for phrase, label in base.items()] + [(label, False, parse(t)) for label, ts in templates.items() for t in ts]
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan([parts for _, _, parts in rows]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, places array<struct<template:int, first_word:long, end_word:long>>")

    def of_template(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])

    labels, is_base, demanded = of_template([r[0] for r in rows]), of_template([r[1] for r in rows]), of_template([mandatory(r[2]) for r in rows])
    named = F.transform(
        "places",
        lambda p: F.struct(p["first_word"].alias("first_word"), p["end_word"].alias("end_word"), F.get(labels, p["template"]).alias("label"), F.get(is_base, p["template"]).alias("base"), F.get(demanded, p["template"]).alias("mandatory")),
    )
    return found.select("doc_id", "n_words", F.array_sort(named).alias("places"))


#: A place that demands so many words has score 0.5.
HALF_WORDS = 4


def license_labels(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """The digest of license_places(): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is m / (m + 4) for the place that demands most words (m): the more wording has to match, the less it does by chance. 0 without places.
    """

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    at_base = F.filter("places", lambda p: p["base"])
    most = F.array_max(F.transform("places", lambda p: p["mandatory"]))
    return license_places(docs, templates, base).select("doc_id", "n_words", "places", at_base.alias("b")).select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(F.transform("b", lambda p: p["first_word"])).alias("first_word"), F.array_max(F.transform("b", lambda p: p["first_word"])).alias("last_word"),
        joined(F.col("b")).alias("base_labels"), joined(F.col("places")).alias("labels"), F.coalesce(most / (most + HALF_WORDS), F.lit(0.0)).alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Base phrases by places in the list of words, templates as regular expressions over the joined words."""
    base = []
    for phrase, label in BASE.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(words))
        base.append((label, f"list_filter(range(1, len(w) + 1), lambda i: {same})", len(words)))
    hits = [(label, f"regexp_matches(s, ' {as_pattern(parts)}')", mandatory(parts)) for label, ts in TEMPLATES.items() for parts in map(parse, ts)]
    hits += [(label, f"len(b_{label}) > 0", m) for label, _, m in base]
    labels = ", ".join(f"CASE WHEN {hit} THEN '{label}' END" for label, hit, _ in hits)
    most = ", ".join(f"CASE WHEN {hit} THEN {m} END" for _, hit, m in hits)
    every = f"flatten([{', '.join(f'b_{label}' for label, _, _ in base)}])"
    base_labels = ", ".join(f"CASE WHEN len(b_{label}) > 0 THEN '{label}' END" for label, _, _ in base)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {', '.join(f'{found} AS b_{label}' for label, found, _ in base)} FROM d),
h AS (SELECT doc_id, len(w) AS n_words, {every} AS b, [{base_labels}] AS bl, [{labels}] AS l, list_max([{most}]) AS m FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, CAST(list_min(b) - 1 AS BIGINT) AS first_word, CAST(list_max(b) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels, array_to_string(list_sort(list_distinct(l)), ',') AS labels, coalesce(m / (m + {HALF_WORDS}), 0.0) AS score FROM h
"""


ORACLE_SQL = _oracle()
