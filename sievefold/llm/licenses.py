"""Operator 1: licence scan with a positional index of rare words.

Every template is a licence notice or phrase. Corpus-wide document counts of the templates' words
give each template its anchors: its words of highest IDF, with their positions. A document looks its
words up among the anchors; postings of one template that agree on where it would begin, give or take a few words, are
intersected, and the mandatory key phrases are then verified word by word: the first at that place, each further one near where the
phrase before it puts it, so that names, years and changed words between them do no harm. Templates
that are phrases alone have every word mandatory, so that all their places are found.

Templates are a parameter: (label, text, key phrases) of each. The default ones are the base phrases, NOTICES, and TEXTS,
the opening or whole bodies of common licences; several templates may share a label.

Null and empty texts have no words, no labels and score 0. Very long texts are scanned whole. Of several notices the
best score counts, and places that tie all count. Repeated rows give repeated rows; an empty table gives an empty result.
Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, words

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label, notice, key phrases that have to stand in it.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "copy of this software")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("lgpl", "GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "GNU Affero General Public License", ("gnu affero general public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    ("cc0", "CC0 1.0 Universal public domain dedication", ("cc0 1 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    ("epl", "made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)
#: Bodies of licences, as their owners publish them, with key phrases.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", ("to deal in the software without restriction", "sublicense and or sell copies of the software")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("provided that the above copyright notice and this permission notice appear in all copies", "the author disclaims all warranties")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing")),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", ("under the terms of the gnu general public license", "either version 3 of the license")),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("under the terms of the gnu general public license", "either version 2 of the license")),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
)
ANCHORS = 3
SHIFT = 16  # words by which a key phrase may stand nearer to the one before it, or farther, than in the template


class Template:
    def __init__(self, label: str, text: str, keys: tuple[str, ...], base: bool):
        self.label, self.base, self.words = label, base, words(text)
        self.keys = []  # (position, words)
        for key in keys:
            k = words(key)
            at = next((i for i in range(len(self.words)) if k and self.words[i : i + len(k)] == k), None)
            if at is None:
                raise ValueError(f"the template {label!r} doesn't hold its key phrase {key!r}")
            self.keys.append((at, k))
        if not self.keys:
            raise ValueError(f"the template {label!r} has no key phrase")
        self.keys.sort()


def templates(notices: Iterable[tuple[str, str, tuple[str, ...]]] = (*NOTICES, *TEXTS)) -> list[Template]:
    """The base phrases, which always count, and the notices."""
    return [Template(label, p, (p,), True) for p, label in BASE.items()] + [Template(label, t, keys, False) for label, t, keys in notices]


def document_counts(docs: DataFrame, vocabulary: set[str], *, text: str = "text") -> tuple[dict[str, int], int]:
    """Of each word of the vocabulary, how many documents hold it; and how many documents there are.

    Tasks count on their own and Spark adds up; the driver gets a row per word of the fixed vocabulary.
    """

    def run(batches):
        seen: Counter[str] = Counter()
        n = 0
        for b in slices(batches, column=0):
            for s in b.column(0).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words(s)))
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    got = {r["word"]: r["n"] for r in docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop("", 0)


def build_index(known: list[Template], counts: dict[str, int], total: int) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position) for each template's anchors."""
    idf = lambda w: math.log((total + 1) / (counts.get(w, 0) + 1))
    index = defaultdict(list)
    for t, template in enumerate(known):
        within = {i for at, k in template.keys for i in range(at, at + len(k))}  # anchors stand in what is mandatory
        rarest = sorted(within, key=lambda i: (-idf(template.words[i]), i))
        first_at, first = template.keys[0]
        lead = next(i for i in rarest if first_at <= i < first_at + len(first))  # one is in the first phrase, whose place the others follow
        for i in [lead, *(i for i in rarest if i != lead)][: 1 if template.base else ANCHORS]:
            index[template.words[i]].append((t, i))
    return dict(index)


def shifts(own: list[str], begin: int, template: Template) -> list[tuple[int, int]] | None:
    """(place in the template, shift) of its key phrases, if the first stands where begin puts it and each further one within SHIFT of where
    the one before it puts it; of several places the nearest counts, then the earlier."""
    out, shift = [], 0
    for nth, (at, k) in enumerate(template.keys):
        near = (0,) if nth == 0 else sorted(range(-SHIFT, SHIFT + 1), key=lambda d: (abs(d), d))
        place = begin + at + shift
        found = next((d for d in near if place + d >= 0 and own[place + d : place + d + len(k)] == k), None)
        if found is None:
            return None
        shift += found
        out.append((at, shift))
    return out


def in_place(own: list[str], begin: int, template: Template, moved: list[tuple[int, int]]) -> int:
    """How many of the template's words stand where the last key phrase before them puts them."""
    same, nth, shift = 0, 0, 0
    for i, w in enumerate(template.words):
        while nth < len(moved) and moved[nth][0] <= i:
            shift, nth = moved[nth][1], nth + 1
        at = begin + i + shift
        same += 0 <= at < len(own) and own[at] == w
    return same


def scan(text: str | None, known: list[Template], index: dict[str, list[tuple[int, int]]], anchors: dict[int, list[int]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = words(text)
    votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # template -> anchor -> where it would begin
    for at, w in enumerate(own):
        for t, i in index.get(w, ()):
            votes[t][i].add(at - i)
    starts, base, labels, score = set(), set(), set(), 0.0
    for t, found in votes.items():
        if len(found) < len(anchors[t]):
            continue
        template, slack = known[t], SHIFT * (len(known[t].keys) - 1)
        ranges = {i: sorted(found[i]) for i in anchors[t][1:]}
        for begin in sorted(found[anchors[t][0]]):
            if not all(_near(places, begin, slack) for places in ranges.values()):
                continue
            moved = shifts(own, begin, template)
            if moved is None:
                continue
            labels.add(template.label)
            if template.base:
                base.add(template.label)
                starts.add((begin, t))
                score = max(score, 0.9)
            else:
                score = max(score, 0.5 + 0.5 * in_place(own, begin, template, moved) / len(template.words))
    at = [s for s, _ in starts]
    return len(own), len(starts), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def anchors_of(index: dict[str, list[tuple[int, int]]]) -> dict[int, list[int]]:
    """Each template's anchors; the first one stands in its first phrase."""
    by: dict[int, list[int]] = defaultdict(list)
    for postings in index.values():
        for t, i in postings:
            by[t].append(i)
    return {t: sorted(places) for t, places in by.items()}


def _near(places: list[int], begin: int, slack: int) -> bool:
    at = bisect_left(places, begin - slack)
    return at < len(places) and places[at] <= begin + slack


def license_scan(docs: DataFrame, *, notices: Iterable[tuple[str, str, tuple[str, ...]]] = (*NOTICES, *TEXTS), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Two passes over the texts and no shuffle of documents: the first counts the templates' words for
    the IDF, the second scans. score is 0 without a label, 0.9 for a base phrase, and up to 1 as more
    of a notice's words stand in place.
    """
    known = templates(notices)
    counts, total = document_counts(docs, {w for t in known for w in t.words}, text=text)
    index = build_index(known, counts, total)
    anchors = anchors_of(index)
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def run(batches):
        for b in slices(batches, column=1):
            found = [scan(s, known, index, anchors) for s in b.column(1).to_pylist()]
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], names=["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(doc_id, text).mapInArrow(run, schema)
