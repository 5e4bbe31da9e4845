"""Leaks with changed words, and rows that are equal thousands of times."""

import random

import numpy as np
import pytest

pytest.importorskip("loomfold.llm.queries")
from loomfold.llm import decontaminate, line_dedup  # noqa: E402
from loomfold.llm.decontaminate import DRIFT, overlaps  # noqa: E402


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_overlap_is_the_common_subsequence_near_its_place():
    rng = random.Random(1)
    for _ in range(300):
        part = [rng.randrange(40) for _ in range(rng.randint(1, 25))]
        copy = list(part)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(copy) + 1)
            copy[at : at + rng.randint(0, 1)] = [rng.randrange(100, 140)] * rng.randint(0, 1)
        before, after = ([rng.randrange(200, 260) for _ in range(rng.randint(0, 40))] for _ in range(2))
        got = overlap(np.array(part, np.uint64), np.array(before + copy + after, np.uint64))
        assert got == pytest.approx(common(part, copy) / len(part))
    assert overlap(np.zeros(0, np.uint64), np.zeros(3, np.uint64)) == 1.0 and overlap(np.ones(3, np.uint64), np.zeros(0, np.uint64)) == 0.0
    words = np.arange(60, dtype=np.uint64)
    assert overlap(words[:20], np.random.default_rng(0).permutation(words)) < 0.5  # the same words elsewhere and out of order
    item = np.concatenate([np.array([7, 8, 7], np.uint64), words[10:40]])  # a short part goes where the whole item is, not where its words are frequent
    assert overlaps([item[:3], item[3:]], np.concatenate([np.tile(np.array([7, 8], np.uint64), 20), words[41:50], item])) == [1.0, 1.0]
    far = np.concatenate([words[:4], np.full(10 * DRIFT, 99, np.uint64), words[4:8]])
    assert overlap(words[:8], far) == 0.5


def overlap(part, around):
    return overlaps([part], around)[0]


def edited(words, edits, rng):
    """Words changed, left out or put in at different places."""
    out = list(words)
    for at in sorted(rng.sample(range(len(out)), edits), reverse=True):
        kind = rng.choice(["change", "drop", "insert"])
        out[at : at + (kind != "insert")] = [] if kind == "drop" else [f"new{rng.randrange(10**6)}"]
    return out


def test_recall_after_edits(spark, sf_dir):
    """Of planted passages none is lost with up to one edit, and nine in ten are found with three; clean documents stay."""
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) >= 16]
    filler = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() for w in r.text.split()[:200]]
    docs, want = [], {}
    for edits in range(4):
        for item, text in items:
            for _ in range(4):
                around = [rng.choices(filler, k=rng.randint(10, 80)) for _ in range(2)]
                want[len(docs)] = edits, item
                docs.append((len(docs), " ".join(around[0] + edited(text.split(), edits, rng) + around[1])))
    clean = {len(docs) + k for k in range(300)}
    docs += [(k, " ".join(rng.choices(filler, k=rng.randint(5, 400)))) for k in sorted(clean)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(rows, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    recall = {e: np.mean([(d, i) in found for d, (own, i) in want.items() if own == e]) for e in range(4)}
    assert recall[0] == recall[1] == 1 and recall[2] >= 0.95 and recall[3] >= 0.9
    assert not {d for d, _ in found} & clean


def test_equal_rows_are_one_document_however_many(spark):
    text = "\n".join(f"line {k} with a few more words in it to reach the length of a run" for k in range(50))
    one = spark.createDataFrame([(None, text), (5, text + "\nown end")], "doc_id bigint, text string")
    many = one.union(spark.range(30_000).selectExpr("cast(null as bigint) doc_id").crossJoin(one.where("doc_id is null").select("text")).repartition(8)).cache()
    runs = line_dedup._copies(many, 50)
    assert runs.select("d").distinct().count() == 1 and runs.count() <= 200
    got = {(r.doc_id, r.lines_gone, r.n): r for r in line_dedup.dedup_lines(many).groupBy("doc_id", "lines_gone").count().withColumnRenamed("count", "n").collect()}
    assert set(got) == {(None, 0, 30_001), (5, 50, 1)}
