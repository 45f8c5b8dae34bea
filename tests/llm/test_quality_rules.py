"""Statistics and minimum-covariance-determinant outliers against plain Python."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import numpy as np

from quarry.llm import quality_rules as qr


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dups = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered),
        len(re.findall("[A-Z]", text)), len(re.findall("[.,;:!?]", text)),
    )


def weighted(x, weight, share, floors):
    m = weight @ x / weight.sum()
    d = x - m
    scatter = (d * weight[:, None]).T @ d / weight.sum() * (qr.consistency(share, x.shape[1]) if share < 1 else 1) + np.diag(np.square(floors))
    return m, scatter


def slow_mcd(x, share, floors, reweight=True):
    """Location, scatter and determinant of one pool: every start followed to its end, exact nearest shares."""
    p, n = x.shape[1], len(x)
    mid = lambda v: np.sort(v, axis=0)[int(np.ceil(len(v) / 2)) - 1]
    med = mid(x)
    scale = np.sqrt((1.4826 * mid(np.abs(x - med))) ** 2 + np.square(floors))
    z = (x - med) / scale
    best = None
    for y in (None, np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
        r = np.eye(p)
        if y is not None:
            s = y.T @ y
            r = 0.99 * s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
            np.fill_diagonal(r, 1)
        m, scatter, last = med, r * np.outer(scale, scale), np.inf
        for _ in range(60):
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(scatter), x - m)
            weight = np.zeros(n)
            weight[np.argsort(d, kind="stable")[: int(np.ceil(share * n))]] = 1.0
            after = weighted(x, weight, share, floors)
            det = np.linalg.slogdet(after[1])[1]
            if det >= last - 1e-12:
                break
            m, scatter, last = *after, det
        if best is None or last < best[2]:
            best = m, scatter, last
    if not reweight:
        return best
    d = np.einsum("ni,ij,nj->n", x - best[0], np.linalg.inv(best[1]), x - best[0])
    return *weighted(x, (d <= qr.chi2_quantile(0.975, p)).astype(float), 0.975, floors), best[2]


def test_statistics_of_hand_made_texts():
    for text in (None, "", " \n\t", "a b", "é|ß <x>\n\na\na\n a\n", "one two three four five " * 3 + "X. Y, Z!", "a " * 30, "\x1fa\xa0b c"):
        assert qr.statistics(None if text is None else text.encode()) == slow_stats(text)


def test_chi_square():
    assert abs(qr.chi2_cdf(14.0671, 7) - 0.95) < 1e-5 and abs(qr.chi2_quantile(0.975, 7) - 16.0128) < 1e-3


def pooled(spark, pools):
    return spark.createDataFrame([(k, [float(c) for c in row]) for k, x in pools.items() for row in x], "pool string, v array<double>")


def inverse(triangle, p):
    out = np.zeros((p, p))
    for (i, j), v in zip([(i, j) for i in range(p) for j in range(i, p)], triangle):
        out[i, j] = out[j, i] = v
    return out


def test_lowest_determinant_of_all_subsets(spark):
    """Small pools in two dimensions: the estimate is that of the best of all subsets."""
    rng, pools, floors = np.random.default_rng(4), {}, [0.05, 0.05]
    for k in range(6):
        good = rng.normal(size=(10, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
        pools[f"p{k}"] = np.vstack([good, rng.normal(size=(3, 2)) * 0.3 + [6 + k, -5]])
    got = {r.pool: r for r in qr.mcd_estimates(pooled(spark, pools), share=10 / 13, floors=floors, reweight=False).collect()}
    for k, x in pools.items():
        best = min((np.linalg.slogdet(weighted(x[list(c)], np.ones(10), 10 / 13, floors)[1])[1], c) for c in combinations(range(13), 10))
        assert best[0] <= got[k].logdet + 1e-6 and got[k].logdet < best[0] + 0.05, (k, best, got[k].logdet)
        m, scatter = weighted(x[list(best[1])], np.ones(10), 10 / 13, floors)
        assert np.allclose(got[k].m, m, atol=0.1)


def test_share_in_weight_is_exact(spark):
    """Vectors at equal distances share the weight that is left, so no subset weighs more than another."""
    x = np.array([[1.0, 0], [-1, 0], [0, 1], [0, -1]])
    got = qr.mcd_estimates(pooled(spark, {"a": x}), share=0.5, floors=[0.1, 0.1], reweight=False).first()
    assert np.allclose(got.m, [0, 0]) and np.allclose(np.linalg.inv(inverse(got.w, 2)), np.eye(2) * (0.5 * qr.consistency(0.5, 2) + 0.01))


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"))
    least = 60
    got = {(r.doc_id, r.text): r for r in qr.judge(docs, least=least).collect()}
    groups, vectors = defaultdict(set), {}
    for (i, text), r in got.items():
        s = qr.statistics(text.encode())
        assert tuple(r.stats) == s
        assert r.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0])
        if not r.base_failed:
            w, c = s[0], s[1]
            vectors[i, text] = (np.log(w), np.log(c / w), *np.sqrt([s[2] / c, s[3] / w, s[4] / w, s[5] / c, s[6] / c]))
            groups[r.lang, r.source].add(vectors[i, text])
    rest = defaultdict(int)
    for (lang, _), v in groups.items():
        rest[lang] += len(v) if len(v) < least else 0
    pool = {k: k if len(v) >= least else k[0] if rest[k[0]] >= least else "all" for k, v in groups.items()}
    members = defaultdict(set)
    for k, v in groups.items():
        members[pool[k]] |= v
    fit = {k: slow_mcd(np.array(sorted(v)), qr.SHARE, list(qr.FLOORS.values())) for k, v in members.items()}
    cut, judged, agree = qr.chi2_quantile(0.99999, 7), 0, 0
    for k, r in got.items():
        if k in vectors:
            m, scatter, _ = fit[pool[r.lang, r.source]]
            d = (vectors[k] - m) @ np.linalg.inv(scatter) @ (vectors[k] - m)
            judged += 1
            agree += abs(d - r.distance) < 0.05 * max(1, d)  # places of the distance scale are 1 % wide
            assert r.kept == (r.distance <= cut)
            assert r.kept == (d <= cut) or abs(d - cut) < 0.1 * cut
        else:
            assert r.distance is None and not r.kept
    assert judged > 500 and agree > 0.99 * judged and 20 < sum(not r.kept and not r.base_failed for r in got.values()) < 200


def test_clashing_columns_stay(spark):
    rows = [(i, f"word{i} " * 3 + "one two three four five six seven eight nine ten", "en", "a", "x", "y", "z", "q") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m string, w string, v string, pool string")
    got = qr.judge(docs).collect()
    assert len(got) == 50 and all((r.m, r.w, r.v, r.pool) == ("x", "y", "z", "q") and r.distance is not None for r in got)


def test_corner_cases(spark):
    rows = [(None, "word " * 4 + "six seven eight nine ten eleven", None, None, "s")] * 2 + [(1, None, "en", "a", "s"), (2, "", "en", "a", None), (3, "x y z " * 100_000, "en", "a", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, stats string")
    got = qr.judge(docs).collect()
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in got) == [(0, False, True)] * 2 + [(1, True, False), (2, True, False), (3, True, False)]
    assert qr.judge(docs.limit(0)).count() == 0
