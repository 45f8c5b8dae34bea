"""License scans with a positional index of rare licence words.

Templates are notices, openings and bodies of licences. Their rarest words, by document frequency over the whole corpus,
form the index: word -> (template, position). A file looks up all its words of the index from the highest IDF down. Every
place and posting vote for the offset at which the template would start; votes may lie apart by a slack that grows with the
template, so inserted and dropped words shift a part of the template and not the result. Where the votes of one stretch
hold enough of the template's rare words, by IDF weight, and the mandatory phrases stand there, the label is given.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tokens import alnum_words, small_batches, utf8

#: Phrase -> label of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = "GNU {0}General Public License as published by the Free Software Foundation; either version {1} of the License"
_CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
_NOTE = "Licensed under the GNU {0}General Public License, version {1}."

#: Fixed values, (label, mandatory phrases, text): words of public licences and of the usual notices.
TEMPLATES = [
    ("apache-2.0", ("apache license",), "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", ("apache license", "compliance with the license"), "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", ("mit license",), "Released under the MIT License."),
    ("mit", ("mit license",), "Licensed under the MIT License."),
    ("mit", ("permission is hereby granted",), _GRANT),
    ("gpl-3.0", ("gnu general public license", "version 3"), "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", ("gnu general public license", "version 2"), "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", ("gnu general public license", "version 3"), _GNU.format("", "3")),
    ("gpl-2.0", ("gnu general public license", "version 2"), _GNU.format("", "2")),
    ("lgpl", ("lesser general public license",), _NOTE.format("Lesser ", "3")),
    ("lgpl", ("lesser general public license",), _GNU.format("Lesser ", "2.1")),
    ("agpl-3.0", ("affero general public license",), _NOTE.format("Affero ", "3")),
    ("agpl-3.0", ("affero general public license",), _GNU.format("Affero ", "3")),
    ("cc-by-nc-4.0", ("cc by nc",), "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", ("cc by sa",), "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", ("cc by 4",), "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", ("attribution noncommercial 4",), _CC.format(" NonCommercial")),
    ("cc-by-sa-4.0", ("attribution sharealike 4",), _CC.format(" ShareAlike")),
    ("cc-by-4.0", ("attribution 4",), _CC.format("")),
    ("cc0-1.0", ("cc0 1",), "Dedicated to the public domain under CC0 1.0."),
    ("cc0-1.0", ("public domain", "waiving all"), "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("mpl-2.0", ("mozilla public license",), "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("mpl-2.0", ("mozilla public license",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0."),
    ("bsd", ("redistribution and use",), "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", ("redistribution and use",), _BSD),
    ("isc", ("permission to use copy modify",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", ("altered source versions",), "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", ("released into the public domain",), "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1.0", ("boost software license",), "Distributed under the Boost Software License, Version 1.0."),
    ("epl-2.0", ("eclipse public license",), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
]
#: Identifier of a licence line in source files -> label.
IDENTIFIERS = {
    "Apache-2.0": "apache-2.0", "MIT": "mit", "GPL-2.0": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl-3.0",
    "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "ISC": "isc", "Zlib": "zlib", "Unlicense": "unlicense", "BSL-1.0": "bsl-1.0", "EPL-2.0": "epl-2.0",
    "MPL-2.0": "mpl-2.0", "CC0-1.0": "cc0-1.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "CC-BY-NC-4.0": "cc-by-nc-4.0",
}
TEMPLATES += [(label, (f"identifier {name}",), f"SPDX-License-Identifier: {name}") for name, label in IDENTIFIERS.items()]


def _find(words: list[bytes], phrase: list[bytes], start: int = 0, end: int | None = None) -> list[int]:
    n = len(phrase)
    end = len(words) if end is None else min(end, len(words))
    return [i for i in range(max(0, start), end - n + 1) if words[i] == phrase[0] and words[i : i + n] == phrase]


@dataclass
class Template:
    label: str
    phrases: list[list[bytes]]
    size: int
    slack: int
    rare: list[tuple[int, bytes]]  # positions and words of the postings
    total: float = 0.0


@dataclass
class Index:
    """Bounded by the templates."""

    templates: list[Template]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]]
    share: float

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """(labels, highest share of a template's rare words, by IDF weight, found in place)."""
        have = sorted(self.postings.keys() & set(words), key=lambda w: (-self.idf[w], w))
        weight: Counter = Counter()
        for w in have:
            for t, _ in self.postings[w]:
                weight[t] += self.idf[w]
        likely = sorted(t for t, x in weight.items() if x >= self.share * self.templates[t].total - 1e-9)
        if not likely:
            return set(), 0.0
        places: dict[bytes, list[int]] = defaultdict(list)
        wanted = {w for t in likely for _, w in self.templates[t].rare}
        for at, w in enumerate(words):
            if w in wanted:
                places[w].append(at)
        labels, best = set(), 0.0
        for t in likely:
            found, share = self._in_place(self.templates[t], words, places)
            best = max(best, share)
            if found:
                labels.add(self.templates[t].label)
        return labels, min(1.0, best)

    def _in_place(self, one: Template, words: list[bytes], places: dict[bytes, list[int]]) -> tuple[bool, float]:
        """Whether the template stands somewhere with its phrases, and the best share of its rare words in one stretch. A
        stretch begins at any vote and holds the votes up to twice the slack further on."""
        votes = sorted((p - q, q, w) for q, w in one.rare for p in places.get(w, ()))
        inside: Counter = Counter()
        held, last, best, found = 0.0, 0, 0.0, False
        for at, q, w in votes:
            while last < len(votes) and votes[last][0] <= at + 2 * one.slack:
                _, q2, w2 = votes[last]
                held += self.idf[w2] * (not inside[q2])
                inside[q2] += 1
                last += 1
            best = max(best, held)
            if not found and held >= self.share * one.total - 1e-9:
                start, end = at, at + one.size + 2 * one.slack
                found = all(_find(words, phrase, start, end) for phrase in one.phrases)
            inside[q] -= 1
            held -= self.idf[w] * (not inside[q])
        return found, best / one.total


def build(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, tuple[str, ...], str]] = TEMPLATES, rare: int = 24, share: float = 0.6) -> Index:
    """The index of ``templates`` (label, mandatory phrases, text) with document frequencies over all of ``docs``. Postings of
    a template are its ``rare`` places with the least frequent words, three fifths of a short one's. Any number of templates."""
    small_batches(docs.sparkSession)
    cut = [(label, [alnum_words(p.encode()) for p in phrases], alnum_words(text.encode())) for label, phrases, text in templates]
    vocab = sorted({w for _, _, words in cut for w in words})
    ids = {w: i for i, w in enumerate(vocab)}

    def frequencies(batches):
        seen, total = np.zeros(len(vocab), dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                seen[[ids[w] for w in ids.keys() & set(alnum_words(text))]] += 1
                total += 1
        yield pd.DataFrame({"word": [-1, *range(len(vocab))], "n": [total, *seen.tolist()]})

    df = {r.word: r.n for r in docs.select(utf8(text_col).alias("text")).mapInPandas(frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    idf = {w: math.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) + 1e-3 for w, i in ids.items()}
    made, postings = [], defaultdict(list)
    for t, (label, phrases, words) in enumerate(cut):
        most = max(2, min(rare, -(-3 * len(words) // 5)))
        chosen = sorted(sorted(range(len(words)), key=lambda q: (-idf[words[q]], q))[:most])
        for q in chosen:
            postings[words[q]].append((t, q))
        made.append(Template(label, phrases, len(words), 1 + len(words) // 8, [(q, words[q]) for q in chosen], sum(idf[words[q]] for q in chosen)))
    return Index(made, idf, dict(postings), share)


_KIND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
    ]
)


def with_licenses(docs: DataFrame, index: Index, text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` plus ``license``: n_words; n_base places of ``phrases``, the first and last word position of one (null
    without any); base_labels; labels (base and templates, sorted); score: the highest IDF-weighted share of a template's
    rare words found in place, 1 with a base label, 0 where no template can reach the share asked for. Null and empty texts
    have no words; texts of any length are read whole; repeated rows are scanned alike. A column ``license`` is replaced; an
    empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    small_batches(docs.sparkSession)
    wanted = [(alnum_words(p.encode()), label) for p, label in phrases.items()]

    @F.pandas_udf(_KIND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = alnum_words(text)
            have = set(words)
            at, base = [], set()
            for phrase, label in wanted:
                if have.issuperset(phrase) and (hits := _find(words, phrase)):
                    at += hits
                    base.add(label)
            labels, score = shared.value.scan(words)
            rows.append((len(words), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | labels), 1.0 if base else score))
        out = pd.DataFrame(rows, columns=_KIND.fieldNames())
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn("license", scan.asNondeterministic()(utf8(text_col)))
