"""License scans: base phrases against a regex model, templates in and out of place, corner cases."""

from __future__ import annotations

import math
import re
from collections import Counter

from quarry.llm import licenses as lic
from quarry.llm.queries import op9_license_scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def in_place(words, notice, rare, idf, phrases, share):
    """The rule as stated, vote by vote."""
    slack = 1 + len(notice) // 8
    votes = [(p - q, q) for q in rare for p in range(len(words)) if words[p] == notice[q]]
    for at in {a for a, _ in votes}:
        inside = {q for a, q in votes if at <= a <= at + 2 * slack}
        part = words[max(0, at) : max(0, at + len(notice) + 2 * slack)]
        if sum(idf[notice[q]] for q in inside) >= share * sum(idf[notice[q]] for q in rare) - 1e-9:
            if all(any(part[i : i + len(p)] == p for i in range(len(part))) for p in phrases):
                return True
    return False


def slow(text, df, total):
    words, at, base = words_of(text), [], set()
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    found = set()
    for label, phrases, notice in lic.TEMPLATES:
        n = words_of(notice)
        idf = {w: math.log((1 + total) / (1 + df[w])) + 1e-3 for w in n}
        rare = sorted(range(len(n)), key=lambda q: (-idf[n[q]], q))[: max(2, min(24, math.ceil(0.6 * len(n))))]
        if len(set(words) & {n[q] for q in rare}) > 1 and in_place(words, n, rare, idf, [words_of(p) for p in phrases], 0.6):
            found.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | found)


def test_whole_table_equals_the_model(spark, sf):
    """The whole query against the rule in plain Python, with document frequencies of its own."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = Counter(w for t in texts.values() for w in set(words_of(t)))
    seen = 0
    for r in op9_license_scan(spark, sf).collect():
        n_words, n_base, first, last, base, labels = slow(texts[r.doc_id], df, len(texts))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n_words, n_base, first, last, ",".join(base), ",".join(labels))
        assert 0 <= r.score <= 1 and (r.score >= 0.6 or not labels)
        seen += bool(labels)
    assert seen


def test_other_wordings_and_bodies(spark):
    full = dict((label, text) for label, _, text in lic.TEMPLATES if len(text) > 250)
    less = " ".join(w for i, w in enumerate(full["mit"].split()) if i % 17 != 5)
    more = " ".join(w + (" (hereafter) indeed" if i % 19 == 7 else "") for i, w in enumerate(full["bsd"].split()))
    rows = [
        (1, "This is licensed under the MIT License, see the file.", ["mit"]),
        (2, "// SPDX-License-Identifier: BSD-3-Clause", ["bsd"]),
        (3, "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gpl", "gpl-3.0"]),
        (4, "Copyright 1999 A. Person. " + less + " End.", ["mit"]),
        (5, more, ["bsd"]),
        (6, "a general remark on software, license plates and the public", []),
        (7, "the gnu lesser general public license, version 3, licensed under it", ["gpl", "lgpl"]),
    ]
    noise = [(100 + i, " ".join(f"noise{i} the of and software under license version".split()), []) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + noise], "doc_id long, text string")
    got = {r.doc_id: list(r["license"].labels) for r in lic.with_licenses(docs, lic.build(docs)).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: x for i, _, x in rows} and not any(got[i] for i, _, _ in noise)


def test_any_number_of_templates(spark):
    many = [(f"l{k}", (f"grant {k}",), f"rare{k} words{k} stand here for grant {k} only") for k in range(400)]
    docs = spark.createDataFrame([(1, "so rare7 words7 stand here for grant 7 only"), (2, "rare399 words399 stand here, for grant 399 only"), (3, "rare5 words6 grant 5")], "doc_id long, text string")
    got = {r.doc_id: list(r["license"].labels) for r in lic.with_licenses(docs, lic.build(docs, templates=many), phrases={}).collect()}
    assert got == {1: ["l7"], 2: ["l399"], 3: []}


def test_templates_and_corner_cases(spark):
    rows = [
        (1, "x y. Licensed under the Apache License, Version 2.0! z", ["apache-2.0"]),
        (2, "apache under license the licensed version 0 2", []),
        (3, "CC-BY / all RIGHTS reserved", ["cc-by", "reserved"]),
        (4, None, []),
        (5, "", []),
        (5, "", []),
        (None, "w " * 200_000 + "Released under the MIT License.", ["mit"]),
        (7, "Licensed under CC BY-NC 4.0. " * 3, ["cc-by", "cc-by-nc-4.0"]),
    ]
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows], "doc_id long, text string, license string")
    index = lic.build(docs)
    got = sorted((r.doc_id or 0, list(r["license"].labels)) for r in lic.with_licenses(docs, index).collect())
    assert got == sorted((i or 0, x) for i, _, x in rows)
    assert lic.with_licenses(docs.limit(0), lic.build(docs.limit(0))).count() == 0
