"""Base patterns and bootstrapped patterns against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm import pii
from quarry.llm.queries import op10_pii as pii_query

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    return {"email": True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def slow(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in BASE.items()}


def got(df):
    return [(r.doc_id, {k: [tuple(x) for x in r[k]] for k in pii.KINDS}) for r in df.collect()]


def test_whole_table_equals_the_plain_expressions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, found in got(pii.find(docs)):
        assert {k: found[k] for k in BASE} == slow(texts[i])


def test_random_texts_equal_the_plain_expressions(spark):
    rng = random.Random(11)
    parts = ["a@b.c", "_", "@", ".", "1.2.3.4", "256.1.1.1", "007.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "5", "-", "+1 (234) 567-8901", "+", "é", "x.y", "😀", "(", "12345678901234567", "\n", "q@w-e.rt.y"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for i, found in got(pii.find(docs)):
        assert {k: found[k] for k in BASE} == slow(texts[i]), texts[i]


def contexts(left, right):
    before, after = left.lower().split(), right.lower().split()
    return [p for p in ("L " + " ".join(before[-2:]) if len(before) > 1 else None, f"C {before[-1]} _ {after[0]}" if before and after else None) if p]


KEY = re.compile(r"(?=(?:[^0-9]*[0-9]){5})(?=(?:[^A-Za-z]*[A-Za-z]){5})[A-Za-z0-9_+/=-]{20,}")


def slow_learn(texts, rounds=5, support=3, confidence=0.7):
    """(patterns, trusted values) for texts of blank-separated words."""
    edges, trusted = defaultdict(set), set()
    for text in texts:
        for m in re.finditer(r"\S*[0-9]\S*", text):
            seed = any(a <= m.start() < b for spans in slow(text).values() for a, b in spans)
            value = m.group() if seed else re.sub(r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "", m.group())
            if seed or KEY.fullmatch(value):
                trusted.add(value)
            elif not (re.search("[A-Za-z]", value) or len(re.findall("[0-9]", value)) >= 5):
                continue
            for p in contexts(text[: m.start()], text[m.end() :]):
                edges[p].add(value)
    return slow_bootstrap(edges, trusted, rounds, support, confidence)


def slow_bootstrap(edges, trusted, rounds=5, support=3, confidence=0.7):
    """(patterns, trusted values) from the values of every pattern."""
    shape = lambda v: re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", v))
    for _ in range(rounds):
        conf = {}
        for p, vs in edges.items():
            if len(vs & trusted) >= support:
                alike = Counter(map(shape, vs))
                conf[p] = sum(1 if v in trusted else alike[shape(v)] / len(vs) for v in vs) / len(vs)
        good = {p: c for p, c in conf.items() if c >= confidence}
        new = {v for p in good for v in edges[p]} - trusted
        new = {v for v in new if 1 - math.prod(1 - c for p, c in good.items() if v in edges[p]) >= confidence}
        if not new:
            break
        trusted = trusted | new
    return set(good), trusted


def test_patterns_bootstrap_unseen_identifiers(spark):
    texts = [f"please write to u{i}@mail.com today friend" for i in range(9)]
    texts += ["please write to XK-993817 today friend", "the code was ZZ-112233 nothing more"]
    texts += [f"my contact is u{i}@mail.com or so" for i in range(4)] + ["my contact is XK-993817 or so", "my contact is (QQ-556677) or so"]
    texts += [f"his badge shows {a}-{n} of us" for a, n in (("QQ", 556677), ("XK", 993817))] + ["his badge shows AB-1 of us", "his badge shows QR-77 of us"]
    texts += [f"my name is X{i}Y or not" for i in range(3)] + ["my contact is u9@mail.com or so"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    good, trusted = slow_learn(texts)
    assert {"C to _ today", "C is _ or"} <= good and "QQ-556677" in trusted and "ZZ-112233" not in trusted
    patterns, values = pii.learn(docs.select(pii_seeds(), pii._candidates("text").alias("candidates")))
    assert {r.pattern for r in patterns.collect()} == good and {r.value for r in values.collect()} == trusted
    learned = {i: [texts[i][a:b] for a, b in found["learned"]] for i, found in got(pii.find(docs)) if found["learned"]}
    assert learned[9] == ["XK-993817"] and learned[15] == ["XK-993817"] and learned[16] == ["QQ-556677"] and 10 not in learned


def test_new_identifiers_induce_patterns_of_their_own(spark):
    """Badge numbers stand beside mail addresses in one context; what they teach finds others in a context without any seed."""
    texts = [f"please contact u{i}@mail.com for help" for i in range(6)] + [f"please contact BD-{i}44 for help" for i in range(6)]
    texts += [f"holder of badge BD-{i}44 entered today" for i in range(4)] + [f"holder of badge BD-{i}91 entered today" for i in range(8)]
    texts += ["version of file v1.2 came today"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    learned = {i: [texts[i][a:b] for a, b in found["learned"]] for i, found in got(pii.find(docs))}
    wanted = {i: [re.search(r"BD-[0-9]+", t).group()] for i, t in enumerate(texts) if "BD-" in t}
    assert {i: v for i, v in learned.items() if v} == wanted


def test_keys_and_long_context_words(spark):
    rng, word = random.Random(1), "w" * 300
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(5)]
    texts = [f'x {word}{i % 2} api token = "{k}" end' for i, k in enumerate(keys)] + ['an api token = "abc-55-short" end', "see page 12345 of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    learned = {i: [texts[i][a:b] for a, b in found["learned"]] for i, found in got(pii.find(docs))}
    assert [learned[i] for i in range(7)] == [*[[k] for k in keys], ["abc-55-short"], []]


def slow_tokens(text):
    """[(start, end, value, key, left, right, base)] of tokens: base matches of every kind, then candidates apart from them."""
    spans, out = slow(text), []
    beside = lambda a, b: (text[:a], text[b:])
    for kind in BASE:
        out += [(a, b, text[a:b], False, *beside(a, b), True) for a, b in spans[kind]]
    every = [s for kind in BASE for s in spans[kind]]
    token = rf"(?:(?<![^{pii._SPACE}])[^{pii._SPACE}0-9]*+[0-9][^{pii._SPACE}]*+)"
    for m in re.finditer("|".join([*(BASE[k] for k in ("email", "ip", "phone", "card")), token]), text):
        value = m.group()
        if any(re.search(BASE[k], value) for k in ("email", "ip")) or valid("card", value) or re.search(r"\+[0-9]", value):
            continue
        g = re.search(r"[^\W_](.*[^\W_])?", value, re.DOTALL)
        if not g:
            continue
        a, b = m.start() + g.start(), m.start() + g.end()
        bare = text[a:b]
        if (len(re.findall("[0-9]", bare)) >= 5 or re.search(r"[^\W\d_]", bare)) and not any(a < y and b > x for x, y in every):
            out.append((a, b, bare, bool(KEY.fullmatch(bare)), *beside(m.start(), m.end()), False))
    return out


def test_whole_query_equals_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    held = docs.select("doc_id", pii_seeds(), *[F.transform(c, lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end"))).alias(k) for k, c in pii.base_spans("text").items()], pii._candidates("text").alias("candidates"))
    held = held.withColumn("candidates", pii._apart("candidates", list(BASE)))
    patterns, values = pii.learn(held)
    trusted = {r.value for r in values.collect()}
    tokens = {i: slow_tokens(t or "") for i, t in texts.items()}
    assert {(r.doc_id, c.start, c.end, c.value, c.key) for r in held.collect() for c in r.candidates} == {(i, *x[:4]) for i, xs in tokens.items() for x in xs if not x[6]}
    edges = defaultdict(set)
    good = {r.pattern: r.conf for r in patterns.collect()}
    for r in held.collect():
        for z in [*r.seeds, *r.candidates]:
            two = [f"L {z.left.lower()}"] if " " in z.left else []
            around = [f"C {z.left.lower().split(' ')[-1]} _ {z.right.lower()}"] if z.left and z.right else []
            for p in two + around:
                edges[p].add(z.value)
    seeds = {x[2] for xs in tokens.values() for x in xs if x[6] or x[3]}
    assert slow_bootstrap(edges, seeds) == (set(good), trusted)
    for r in pii_query(spark, sf).collect():
        i, spans = r.doc_id, slow(texts[r.doc_id])
        learned = sorted({x[:2] for x in tokens[i] if not x[6] and x[2] in trusted})
        said = [f"{k}:{a}:{b}" for k, own in (*spans.items(), ("learned", learned)) for a, b in own]
        assert r.spans == ",".join(said) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans[k]).encode()).hexdigest()
        assert [tuple(x) for x in found[i].discovered] == sorted({x[:2] for x in tokens[i] if not x[6] and x[2] in trusted and not x[3]})


def test_learned_spans_touch_no_base_span(spark):
    texts = [f"ring the desk +1 (599) 555-{3000 + i} today" for i in range(8)] + [f"ring the desk 5{i}5-{77000 + i} today" for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pii.find(docs).collect():
        base = [tuple(s) for k in BASE for s in r[k]]
        assert not any(a < y and b > x for a, b in map(tuple, r.learned) for x, y in base)


def pii_seeds():
    from pyspark.sql import functions as F

    return F.concat(*pii.base_spans("text").values()).alias("seeds")


def test_corner_cases(spark):
    rows = [(1, None, "e"), (2, "", None), (2, "", None), (None, "x@y.z", "u"), (3, "a" * 300_000 + " 1" * 3_000, "long"), (4, "a." * 20_000 + "@b" + ".c" * 20_000, "deep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string")
    out = got(pii.find(docs))
    assert sorted((i or 0, len(f["email"])) for i, f in out) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 0), (4, 1)]
    assert got(pii.find(docs.limit(0))) == []
