"""Ranked search against a plain computation of every score."""

import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfold.llm import lexical_search
from loomfold.llm.lexical_search import BLOCK, Segment

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, query in queries.items():
        scored = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total if total else 10
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "in"], [f"w{i}" for i in range(400)] + ["Straße", "ÉTÉ", "日本語", "a1b2"]
    out = []
    for _ in range(n):
        words = rng.choices(common, k=rng.randint(0, 40)) + rng.choices(rare, k=rng.randint(0, 15))
        rng.shuffle(words)
        out.append(rng.choice([" ", ", ", "-", "\n"]).join(words))
    return out


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical_search.rank(d, q, **options)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_ranking_equals_brute_force_at_any_segment_size(spark):
    docs = list(enumerate(texts(1, 900)))
    docs += [(2000 + i, docs[i % 7][1]) for i in range(60)]  # copies tie
    items = [(i, t) for i, t in enumerate(texts(2, 25))]
    want = brute(docs, items)
    for size in (1 << 12, 1 << 25):
        assert ranked(spark, docs, items, segment_bytes=size) == want
    assert ranked(spark, docs, items, k=3) == brute(docs, items, 3)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "alpha"), (4, "alpha"), (None, "alpha"), (None, "alpha beta"), (5, "Alpha " * 30_000), (6, "ALPHA İ")]
    items = [(1, "alpha beta"), (2, None), (3, "..."), (None, "beta"), (7, "absent"), (1, "alpha gamma"), (8, "i̇ İ")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []
    extra = spark.createDataFrame([(1, "alpha", 2, "x")], "doc_id bigint, text string, rank int, TERMS string")
    found = lexical_search.rank(extra, spark.createDataFrame([(1, "alpha", 5)], "item_id bigint, text string, doc_id int"))
    assert len(found.collect()) == 0 or found.columns == ["item_id", "rank", "doc_id", "score"]


def test_several_passes_give_the_same(spark, monkeypatch):
    docs, items = list(enumerate(texts(3, 120))), list(enumerate(texts(4, 12)))
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 600)
    assert ranked(spark, docs, items) == brute(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(0, 3))
def test_segment_search_is_exact_above_any_threshold(seed, n_terms, k_power):
    """Short and long lists, skipped blocks and thresholds from outside give the best of a full sum."""
    rng = np.random.default_rng(seed)
    n = BLOCK * 3 + int(rng.integers(0, BLOCK))
    k = 10**k_power // 10 + 1
    lists = [np.sort(rng.choice(n, int(rng.choice([1, 4, n // 50, n // 3, n])), replace=False)) for _ in range(n_terms)]
    scores = [rng.integers(1, 6, len(x)) for x in lists]
    weights = rng.integers(0, 4, n_terms)
    segment = Segment(rng.permutation(n), np.arange(n_terms), np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists), np.concatenate(scores))
    full = np.zeros(n, np.int64)
    for x, s, w in zip(lists, scores, weights, strict=True):
        full[x] += s * w
    order = np.lexsort((segment.ids, -full))[:k]
    order = order[full[order] > 0]
    query = [(t, int(w)) for t, w in enumerate(weights)]
    ids, found = segment.best(query, k, 1)
    assert ids.tolist() == segment.ids[order].tolist() and found.tolist() == full[order].tolist()
    if len(order):
        wanted = int(full[order[-1]])
        ids, found = segment.best(query, k, wanted)
        assert ids.tolist() == segment.ids[order].tolist() and found.tolist() == full[order].tolist()
