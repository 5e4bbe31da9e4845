"""Distances of sources and their terms against a plain computation."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfold.llm import source_audit
from loomfold.llm.source_audit import count_terms, radix_order
from loomfold.llm.textio import utf8

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, least, top):
    groups, docs_with = {}, {}
    for lang, source, text in docs:
        lang, source, found = lang or "", source or "", terms(text)
        groups.setdefault((lang, source), Counter()).update(found)
        docs_with.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang in docs_with:
        kept = [t for t, n in docs_with[lang].items() if n >= least]
        own = {s: c for (l, s), c in groups.items() if l == lang}
        whole = sum(own.values(), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", more, top)):
                ranked = sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audited(spark, docs, **options):
    found = source_audit.audit(spark.createDataFrame(docs, "lang string, source string, text string"), **options)
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(tuple(r) for r in found.collect())


def made(seed, n, sources):
    rng = random.Random(seed)
    words = ["a", "of", "eight888", "exactlyeight", "sixteenletterxyz", "seventeenletterxy", "x" * 40, "éé", "日本語" * 6, "Ä" * 8, "ß", "x" * 41] + [f"word{chr(97 + i)}" for i in range(20)]
    return [(rng.choice(["en", "de"]), f"s{rng.randrange(sources)}", " ".join(rng.choices(words, k=rng.randint(0, 25)))) for _ in range(n)]


def test_audit_equals_brute_force(spark):
    docs = made(5, 300, 6)
    assert audited(spark, docs, least_docs=4, top_terms=5) == brute(docs, 4, 5)
    assert audited(spark, docs, least_docs=30, top_terms=50) == brute(docs, 30, 50)


def test_buckets_of_terms_change_nothing(spark, monkeypatch):
    docs = made(6, 250, 9)
    monkeypatch.setattr(source_audit, "BUCKET", 7)
    assert audited(spark, docs, least_docs=3) == brute(docs, 3, 50)
    assert list(source_audit._tile_sums(iter([]))) == []


def tiled(rows, block):
    """Sums of one language by the tile function itself, a row at a time; rows of (source, {term: share}, absent)."""
    from itertools import product

    batches, n = [], -(-len(rows) // block)
    for i, j in product(range(n), range(n)):
        if i <= j:
            inside = [(k, r) for k, r in enumerate(rows) if k // block in (i, j)]
            lines = [(None, k // block, k % block, r[1]) for k, r in inside] + sorted((t, k // block, k % block, s) for k, r in inside for t, s in r[0].items())
            for t, b, slot, share in lines:
                batches.append(pa.record_batch([pa.array([x], t_) for x, t_ in (("en", pa.string()), (i, pa.int32()), (j, pa.int32()), (0, pa.int32()), (t, pa.string()), (b, pa.int32()), (slot, pa.int32()), (share, pa.int64()))], names=["lang", "i", "j", "bucket", "term", "block", "slot", "share"]))
    return batches


@settings(max_examples=30, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abcdefg"), st.integers(3, 9), max_size=7), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 3))
def test_tile_sums(sources, block, terms_at_once):
    rows = [(s, k % 3 + 1) for k, s in enumerate(sources)]
    before = source_audit.BLOCK, source_audit.TERMS
    source_audit.BLOCK, source_audit.TERMS = block, terms_at_once
    try:
        got = {(a, b): (total, seen) for part in source_audit._tile_sums(iter(tiled(rows, block))) for _, a, b, total, seen in zip(*part.to_pydict().values(), strict=True)}
    finally:
        source_audit.BLOCK, source_audit.TERMS = before
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))]
    for a, b in pairs:
        (one, absent), (two, other) = rows[a], rows[b]
        total, seen = got.get((a, b), (0, 0))  # tiles without terms give none
        assert total + (7 - seen) * abs(absent - other) == sum(abs(one.get(t, absent) - two.get(t, other)) for t in "abcdefg")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text(alphabet="abAZéß日 .1", max_size=60)), max_size=8))
def test_counted_terms(rows):
    data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
    group, term, n, docs = count_terms(data, offsets, np.array([g for g, _ in rows], np.int64))
    got = sorted(zip(group.tolist(), term.to_pylist(), n.tolist(), docs.tolist(), strict=True))
    count, with_term = Counter((g, t) for g, x in rows for t in terms(x)), Counter((g, t) for g, x in rows for t in set(terms(x)))
    assert got == sorted((g, t, k, with_term[g, t]) for (g, t), k in count.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=50))
def test_radix_order(pairs):
    keys = [np.array(x, np.uint64) for x in zip(*pairs, strict=True)] or [np.zeros(0, np.uint64)] * 2
    assert radix_order(*keys).tolist() == sorted(range(len(pairs)), key=lambda i: pairs[i])


def test_edges(spark):
    docs = [(None, None, None), ("", "", "x"), (None, "s", "one one"), (None, "s", "one one"), ("en", None, ""), ("en", "a", "!!"), ("fr", "only", "mot " * 20_000)]
    assert audited(spark, docs, least_docs=2) == brute(docs, 2, 50)
    assert audited(spark, [], least_docs=1) == []
    extra = spark.createDataFrame([("en", "a", "w w", 1, "t"), ("en", "b", "w v", 2, "u")], "lang string, source string, text string, n int, TERM string")
    assert sorted(tuple(r) for r in source_audit.audit(extra, least_docs=1).collect()) == brute([("en", "a", "w w"), ("en", "b", "w v")], 1, 50)
