"""License scans by a positional rare-token index (operator 6).

Templates are whole texts, notices and sentences of well-known licences; each has one mandatory key phrase.  The corpus
gives the document frequency of every template word.  Each template is indexed under its words of the highest IDF, with
their positions, so only those of a file's words are looked up, and all of them: a limit on their number would lose
licences of long files.  The postings are intersected by relative position: a file position less a template position is
the same for all words of one copy, up to a slack for names and small edits.  At places where enough of a template's rare
words agree the mandatory key phrase is verified.  A template that is its own key phrase is found exactly, wherever it
stands: every copy holds its rarest word, and the words about that place are compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, arrow_append, arrow_map, table, texts

#: Phrases found exactly, wherever their words stand consecutively, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Texts of licences, without the lines that name a holder (fixed values).
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to
use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
shall be included in all copies or substantial portions of the software the software is provided as is without warranty of
any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose
and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met redistributions of source code must retain the above copyright notice this list of conditions
and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of
conditions and the following disclaimer in the documentation and or other materials provided with the distribution this
software is provided by the copyright holders and contributors as is and any express or implied warranties including but
not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable
law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
conditions of any kind either express or implied see the license for the specific language governing permissions and
limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
license as published by the free software foundation either version 3 of the license or at your option any later version
this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
of merchantability or fitness for a particular purpose see the gnu general public license for more details"""
_MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
distributed with this file you can obtain one at http mozilla org mpl 2 0"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held
liable for any damages arising from the use of this software permission is granted to anyone to use this software for any
purpose including commercial applications and to alter it and redistribute it freely subject to the following
restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original
software"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
or non commercial and by any means"""
#: (label, template, mandatory key phrase)
TEMPLATES = (
    ("mit", _MIT, "permission is hereby granted free of charge"),
    ("bsd", _BSD, "source and binary forms"),
    ("isc", _ISC, "copy modify and or distribute this software"),
    ("apache", _APACHE, "apache license version 2"),
    ("gpl", _GPL, "gnu general public license"),
    ("mpl", _MPL, "mozilla public license"),
    ("zlib", _ZLIB, "the origin of this software must not be misrepresented"),
    ("unlicense", _UNLICENSE, "free and unencumbered software"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify it"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", "all rights reserved"),
)


#: A template has `rare` indexed words for each so many of its words.
RUN = 16


def words_of(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().translate(FOLD).split())


@dataclass
class Index:
    """Postings of rare template words; `rare` of every RUN words of a template are indexed."""

    idf: dict[bytes, float]
    phrases: tuple = PHRASES
    templates: tuple = TEMPLATES
    rare: int = 4
    agree: float = 0.75
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    anchors: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.exact = [(words_of(p), label) for p, label in self.phrases]
        self.long = [(label, words_of(t), words_of(k)) for label, t, k in self.templates]
        self.indexed = [min(len(t), self.rare * (1 + len(t) // RUN)) for _, t, _ in self.long]
        rarest = lambda words: sorted(range(len(words)), key=lambda i: (-self.idf.get(words[i], np.inf), i))
        for n, (words, _) in enumerate(self.exact):
            at = rarest(words)[0]
            self.anchors.setdefault(words[at], []).append((n, at))
        for n, (_, words, _) in enumerate(self.long):
            for at in rarest(words)[: self.indexed[n]]:
                self.postings.setdefault(words[at], []).append((n, at))
        known = [*self.anchors, *self.postings]
        self.number = {w: i for i, w in enumerate(sorted(set(known), key=lambda w: (-self.idf.get(w, np.inf), w)))}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(start, label) of each exact phrase, and labels with their scores."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        places = np.flatnonzero(ids >= 0)
        base: list[tuple[int, str]] = []
        votes: dict[int, list[tuple[int, int]]] = {}
        for at in places[np.argsort(ids[places], kind="stable")].tolist():  # highest IDF first
            word = words[at]
            for n, k in self.anchors.get(word, ()):
                phrase, label = self.exact[n]
                if at >= k and tuple(words[at - k : at - k + len(phrase)]) == phrase:
                    base.append((at - k, label))
            for n, k in self.postings.get(word, ()):
                votes.setdefault(n, []).append((at - k, k))
        labels = dict.fromkeys((label for _, label in base), 1.0)
        for n, found in votes.items():
            label = self.long[n][0]
            for start in self._agreeing(n, sorted(found)):
                if labels.get(label, 0) == 1:
                    break
                labels |= {label: score} if (score := self._score(n, words, start)) > labels.get(label, 0) else {}
        return sorted(base), labels

    def _slack(self, n: int) -> int:
        return 3 + len(self.long[n][1]) // 20

    def _agreeing(self, n: int, found: list[tuple[int, int]]) -> Iterator[int]:
        """Relative positions from which, within the slack, enough different rare words of the template agree."""
        wanted, reach = self.agree * self.indexed[n], 2 * self._slack(n)
        held: Counter = Counter()
        first = 0
        for at, k in found:
            held[k] += 1
            while found[first][0] < at - reach:
                held[found[first][1]] -= 1
                held += Counter()
                first += 1
            if len(held) >= wanted:
                yield found[first][0]

    def _score(self, n: int, words: list[bytes], start: int) -> float:
        """The share of the template's words that stand about `start`; 0 without its key phrase."""
        _, template, key = self.long[n]
        slack = self._slack(n)
        near = words[max(0, start - slack) : max(0, start + len(template) + 3 * slack)]
        if not any(tuple(near[i : i + len(key)]) == key for i in range(len(near) - len(key) + 1)):
            return 0.0
        return sum((Counter(near) & Counter(template)).values()) / len(template)


def frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary stands, over whole texts of all documents, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = Counter(), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                n.update(vocabulary.intersection((text or b"").translate(FOLD).split()))
            rows += batch.num_rows
        yield pa.RecordBatch.from_pydict({"w": pa.array([*n, b""], pa.binary()), "n": pa.array([*n.values(), rows], pa.int64())})

    rows = arrow_map(docs.select(F.col(text_col).alias("t")), count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.w): r.n for r in rows}
    return {w: n for w, n in found.items() if w}, found.get(b"", 0)


def build(docs: DataFrame, text_col: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> Index:
    vocabulary = {w for p, _ in phrases for w in words_of(p)} | {w for _, t, _ in templates for w in words_of(t)}
    found, total = frequencies(docs, vocabulary, text_col)
    return Index({w: float(np.log((total + 1) / (found.get(w, 0) + 1))) for w in vocabulary}, phrases, templates)


def scan(docs: DataFrame, index: Index | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of `docs` with n_words, base (array<struct<start, label>>), labels and score (0 to 1).

    Null, empty and wordless texts have no words, places or labels and score 0; repeated rows are judged alike; an
    empty table gives no rows; kept columns may have the new columns' names.
    """
    index = build(docs, text_col) if index is None else index
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def start():
        index = shared.value

        def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            n, base, labels, score = [], [], [], []
            for text in texts(batch.column(0)):
                words = (text or b"").translate(FOLD).split()
                places, found = index.scan(words)
                n.append(len(words))
                base.append([{"start": a, "label": b} for a, b in places])
                labels.append(sorted(found))
                score.append(max(found.values(), default=0.0))
            return {
                "n_words": pa.array(n, pa.int64()),
                "base": pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
                "labels": pa.array(labels, pa.list_(pa.string())),
                "score": pa.array(score, pa.float64()),
            }

        return each

    kind = "n_words long, base array<struct<start:long,label:string>>, labels array<string>, score double"
    return arrow_append(docs, [text_col], start, kind, keep)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


QUERIES = {"op6_licenses": op6_licenses}
ORACLES: dict[str, str] = {}
