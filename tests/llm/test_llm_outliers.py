"""op6's estimate and verdict against a numpy version, and op3's proximity matches against a word-by-word one."""

import random
import re
from collections import defaultdict

import numpy as np

from vaxframe.llm import decontaminate, outliers

SF = "/root/testdata/sf0.01"


def fit(x, scale):
    return x.mean(0), np.linalg.cholesky(scale * np.cov(x.T, bias=True) + np.diag(outliers.FLOOR))


def distance(x, centre, factor):
    return (np.linalg.solve(factor, (x - centre).T) ** 2).sum(0)


def estimate(x):
    """(rows of the nearest share, centre, factor) of the start whose determinant is smaller."""
    plain = (x[:, 1] < 0.2) & (x[:, 2] < 0.3) & (x[:, 3] < 0.6)
    found = []
    for start in (x, x[plain]):
        if not len(start):
            continue
        now, scale = start, 1.0
        for _ in range(outliers.STEPS):
            bins = np.floor(np.log(distance(x, *fit(now, scale)) + 1e-6) * 16)
            reach = np.sort(bins)[int(np.ceil(outliers.SUBSET * len(x))) - 1]
            now, scale = x[bins <= reach], outliers.CONSISTENCY
        centre, factor = fit(now, scale)
        found.append((2 * np.log(np.diag(factor)).sum(), len(now), centre, factor))
    return min(found, key=lambda f: f[0])[1:]


def test_estimate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.limit(60).selectExpr("doc_id + 1000000 as doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source").limit(35)
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(few)
    rows = outliers.statistics(docs).collect()
    x = np.array([[
        np.log(max(r.word_chars, 1) / max(r.n_words, 1)), np.sqrt(r.n_symbols / max(r.word_chars, 1)),
        np.sqrt(r.n_dup_lines / (r.n_lines + outliers.PRIOR_LINES)), np.sqrt(r.n_repeat_words / (r.n_words + outliers.PRIOR_WORDS))] for r in rows])
    failed = np.array([r.base_failed for r in rows])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r.lang, r.source].append(i)
    everything = estimate(x[~failed])
    want = np.empty(len(rows))
    for places in groups.values():
        at = np.array(places)
        own = estimate(x[at[~failed[at]]]) if (~failed[at]).any() else (0,)
        want[at] = distance(x[at], *(own if own[0] >= outliers.SUBSET * outliers.LEAST_ROWS else everything)[1:])
    got = {r.doc_id: r for r in outliers.judge(docs).select("doc_id", "d2", "kept").collect()}
    assert len(got) == len(rows) and any(len(p) < outliers.LEAST_ROWS for p in groups.values())
    assert np.allclose([got[r.doc_id].d2 for r in rows], want, rtol=1e-6, atol=1e-8)
    clear = np.abs(want - outliers.CUTOFF) > 1e-4
    kept = ~failed & (want <= outliers.CUTOFF)
    assert all(got[r.doc_id].kept == k for r, k, c in zip(rows, kept, clear, strict=True) if c)
    assert 0 < kept.sum() < (~failed).sum()


def test_proximity(spark):
    """All words of a window stand, in any order, within its length plus the slop words of one document."""
    rng, width, slop = random.Random(9), 4, 2
    item_rows = [(f"i{i}", " ".join(rng.choice("abcdefghijkl") for _ in range(rng.choice([2, 4, 6])))) for i in range(12)] + [("none", ""), (None, "a b c d")]
    doc_rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 60)))) for i in range(40)] + [(90, None), (91, "")]
    want = set()
    for doc_id, text in doc_rows:
        words = re.findall(r"\w+", text or "")
        for item_id, item in item_rows:
            terms = item.split()
            windows = [terms[k:k + width] for k in range(max(len(terms) - width + 1, 1))] if terms else []
            if item_id and any(set(w) <= set(words[k:k + len(w) + slop]) for w in windows for k in range(len(words))):
                want.add((doc_id, item_id))
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(item_rows, "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.proximity_matches(docs, items, width, slop).collect()}
    assert want and got == want
