"""Languages are learned, and thresholds derived, from every labelled row."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

language = pytest.importorskip("loomfold.llm.language")


def test_every_labelled_text_is_learned(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(7000)]
    docs = spark.createDataFrame([(i, w, "xx") for i, w in enumerate(words)] + [(-1, "zzzz", "yy")], "doc_id bigint, text string, lang string")
    filters = language.learn(docs, F.lit(True))
    hashes, _ = language.grams(*language.utf8(pa.array(words)))
    assert filters.languages == ["xx", "yy"] and filters.left_out["xx"] == 0
    assert (filters.masks(hashes, 0) & np.uint64(1)).all()  # 3,000 of 7,000 were drawn


def test_counts_are_whole_however_few_a_task_holds(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 5, 300)) for _ in range(60)]
    batch = pa.record_batch([pa.array([("aa", "bb")[i % 2] for i in range(60)]), pa.array(np.arange(60, dtype=np.int8) // 30), pa.array(texts)], names=["lang", "half", "text"])
    want = {}
    for i, text in enumerate(texts):
        for gram in language.grams(*language.utf8(pa.array([text])))[0].view(np.int64).tolist():
            key = (("aa", "bb")[i % 2], i // 30, gram)
            want[key] = want.get(key, 0) + 1
    for held in (language._HELD, 500):
        monkeypatch.setattr(language, "_HELD", held)
        found = {}
        for out in language._counted(iter([batch.slice(k, 7) for k in range(0, 60, 7)])):
            for lang, half, gram, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                found[lang, half, gram] = found.get((lang, half, gram), 0) + n
        assert found == want


def test_thresholds_come_from_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    own = {"aa": [f"a{k:04d}" for k in range(300)], "bb": [f"b{k:04d}" for k in range(300)]}

    def text(lang, strange):
        return " ".join(f"q{rng.integers(1e9):09d}" if rng.random() < strange else own[lang][rng.integers(300)] for _ in range(30))

    rows = [(i, text(lang, rng.random() * 0.4), lang) for i, lang in enumerate(("aa", "bb") * 2500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters, halves = language.learn_halves(docs)
    lengths = (8, 64)
    got = language.least_shares(docs, filters, halves, lengths, floor=0.02, quantile=0.01)
    half = {r.doc_id: r.half for r in language._rows(docs).collect()}
    groups = {}
    for doc_id, t, _ in rows:
        other = halves[1 - half[doc_id]]
        (name,), _, (share,), (n,) = other.measure(pa.array([t]), other.false_positive_rates())
        groups.setdefault((name, int(np.searchsorted(lengths, n, "right"))), []).append(int(share * 10_000))
    want = np.full((2, 3), 0.02)
    want[:, 0] = 0
    for (name, length), steps in groups.items():
        if length and len(steps) >= 50:
            want[filters.languages.index(name), length] = max(0.02, 0.5 * sorted(steps)[int(np.ceil(0.01 * len(steps))) - 1] / 10_000)
    assert np.allclose(got, want, atol=1e-12) and (want[:, 1:] > 0.02).any()
