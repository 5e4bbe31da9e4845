"""Language, toxicity and fingerprint queries against plain versions over their whole tables, and samples by row."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomfold.llm.queries")
from loomfold.llm import fingerprint, language, queries, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def held_out(doc_id, folds, which):
    return zlib.crc32(str(doc_id).encode()) % folds == which


def plain_grams(text):
    folded = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.encode()).lower()
    return [folded[i : i + 4] for i in range(len(folded) - 3)]


def test_language_query_is_sets_of_grams(spark, sf_dir, documents):
    known = {}
    for d in documents:
        if d["lang"] is not None and d["text"] is not None and not held_out(d["doc_id"], 3, 1):
            known.setdefault(d["lang"], set()).update(plain_grams(d["text"]))
    got = {r.doc_id: r for r in queries.op5_language_id(spark, sf_dir).collect()}
    assert set(got) == {d["doc_id"] for d in documents}
    compared = 0
    for d in documents:
        r = got[d["doc_id"]]
        assert r.held_out == held_out(d["doc_id"], 3, 1)
        hits = {k: sum(g in s for g in plain_grams(d["text"] or "")) for k, s in known.items()}
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(sorted(hits), key=hits.get)
        total = sum(hits.values())
        assert abs(r.score - (max(hits.values()) / total if total else 0.0)) < 0.02
        if sorted(hits.values())[-2] < 0.98 * hits[best]:
            assert r.lang_pred == best
            compared += 1
    assert compared > 0.9 * len(documents)


def plain_model(rows, positive, prior):
    """Full-batch Adam on a dense table of words by document."""
    used = sorted({c for r in rows for c in r})
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(used, sorted(r))] = 1.0
    n_p, n_u = positive.sum(), (~positive).sum()
    in_p, in_u, share = x[positive].sum(0) / n_p, x[~positive].sum(0) / n_u, x.mean(0)
    x *= (x.sum(0) >= 3) & (np.abs(in_p - in_u) >= 5 * np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)))
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 201):
        p = 1 / (1 + np.exp(-(x @ w)))
        own = p * (1 - p)
        negative = p[~positive].mean() - prior * p[positive].mean()
        if negative >= 0:
            g = x.T @ np.where(positive, -2 * prior * own / n_p, own / n_u)
        else:
            g = x.T @ np.where(positive, prior * own / n_p, -own / n_u)
        g[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return used, w


def test_toxicity_query_is_the_risk_minimised_plainly(spark, sf_dir, documents):
    toxic = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if r.toxic is not None and not held_out(r.doc_id, 5, 0):
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)

    def cells(text):
        return set(toxicity.features(pa.array([text or ""]))[1].tolist())

    training = [d for d in documents if not held_out(d["doc_id"], 5, 0) and d["text"] is not None and len(d["text"]) <= 50_000]
    positives = [d for d in training if toxic.get(d["doc_id"]) == 1]
    rows = [cells(d["text"]) for d in positives + training]
    used, w = plain_model(rows, np.arange(len(rows)) < len(positives), sum(toxic.values()) / len(toxic))
    weight = dict(zip(used, w, strict=False))
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf_dir).collect()}
    for d in documents:
        want = 1 / (1 + math.exp(-sum(weight.get(c, 0.0) for c in cells(d["text"])) - w[-1]))
        r = got[d["doc_id"]]
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.5) and r.held_out == held_out(d["doc_id"], 5, 0)


def plain_digest(text):
    data, counts = text.encode(), Counter()
    for salt, picks in enumerate(((0, 1, 2), (0, 2, 3))):
        for i in range(len(data) - picks[-1]):
            h = salt * 0x1B873593
            for p, m in zip(picks, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True):
                h = (h + data[i + p] * m) % 2**32
                h ^= h >> 15
            counts[(h * 0x2C1B3C6D % 2**32) >> 25] += 1
    ranked = sorted(counts[b] for b in range(128))
    q = [ranked[32 * k - 1] for k in (1, 2, 3)]
    head = [min(255, round(10 * math.log1p(len(data)))), 15 * q[0] // max(1, q[2]), 15 * q[1] // max(1, q[2])]
    return head, [sum(counts[b] > k for k in q) for b in range(128)]


def plain_likeness(a, b):
    cost = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[1], b[1], strict=True))
    cost += min(60, abs(a[0][0] - b[0][0])) + 2 * abs(a[0][1] - b[0][1]) + 2 * abs(a[0][2] - b[0][2])
    return max(0.0, 1 - cost / fingerprint.FARTHEST)


def test_likeness_of_all_documents(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, sf_dir).collect()}
    order = sorted(documents, key=lambda d: -d["doc_id"])
    texts = [d["text"] or "" for d in order]
    for d, text, after in zip(order, texts, texts[1:] + texts[:1], strict=True):
        k, r = len(text) // 3, got[d["doc_id"]]
        own, changed, following = map(plain_digest, (text, text[: len(text) - k] + after[:k], after))
        assert math.isclose(r.near_edited, plain_likeness(own, changed), abs_tol=1e-12)
        assert math.isclose(r.near_next, plain_likeness(own, following), abs_tol=1e-12)


def test_texts_of_one_id_are_drawn_apart(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(7, "xx", f"{words[i % 4]} text number {i} of one source") for i in range(4000)] + [(8, "yy", "an other language")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    drawn = []
    kept = language.Filters.build
    monkeypatch.setattr(language.Filters, "build", lambda members, left_out: drawn.append(members) or kept(members, left_out))
    filters = language.learn(docs, F.lit(True), max_training=200)
    grams = {g for _, lang, text in rows if lang == "xx" for g in plain_grams(text)}
    assert filters.languages == ["xx", "yy"] and 20 < len(drawn[0]["xx"]) < len(grams) + 1

    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id bigint, toxic int")
    sizes = []
    fit = toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda p, u, prior: sizes.append((len(p), len(u))) or fit(p, u, prior))
    clean = spark.createDataFrame([(9, "zz", f"a calm {words[i % 4]} page {i}") for i in range(4000)] + [(9, "zz", "the same page")] * 4000, docs.schema)
    toxicity.train(docs.unionByName(clean), labels, F.lit(True), max_positive=100, max_unlabelled=300)
    assert 50 < sizes[0][0] < 200 and 100 < sizes[0][1] < 500  # equal rows count once
