"""Rows of the pipeline's line and encoding stages, and of a whole run, against plain computations."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
sys.path.insert(0, str(Path(__file__).parent))
from test_methods import lines_of, repeated, without  # noqa: E402
from test_pipeline import near_dup_by_brute_force, pairs, table  # noqa: E402

RUN = "\n".join(" ".join(f"w{k}x{j}" for j in range(14)) for k in range(5))  # 70 words


def rows_of(spark, sf_dir):
    """Prose, and rows with repeated runs, without an id, under one id, equal, near, leaked, foreign and letterless."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(90).collect()
    prose = [(1000 + r.doc_id, r.text, r.lang) for r in found if r.text.count("\n") < 60]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rng = random.Random(9)
    noise = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(2000))
    own = prose[3][1]
    return prose + [
        (1, f"the own start\n{RUN}\n\nthe own end", "en"), (2, f"{RUN}\nthat goes on", "en"), (3, RUN, "en"), (3, RUN, "en"), (None, f" {RUN} ", "en"), (4, f"{RUN}\n{RUN}", "en"), (5, RUN.rsplit("\n", 2)[0], "en"),
        (6, own + " and", "en"), (None, own, "en"), (None, own, "en"), (7, f"It is said: {item} So it is.", "en"), (7, "another text under the id of a leak", "en"), (8, noise, None), (9, "12 345", "en"), (10, None, "en"), (11, "", "en"), (12, "A.", "en"),
    ]


def by_order(rows):
    """Distinct rows as the line stage orders them: null ids first, then by id; one text for each id, or their order is by a hash."""
    return sorted({r[:2] for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))


def lines_cut(rows):
    order = by_order(rows)
    gone = dict(zip(order, repeated([t for _, t in order], 50), strict=True))
    out = []
    for i, t in (r[:2] for r in rows):
        cut = gone.get((i, t), set())
        text = without(t, cut) if cut else t
        if not cut or text.strip(" \t\n\v\f\r"):
            out.append((i, text))
    return out


def test_line_stage(spark, sf_dir):
    rows = [r for r in rows_of(spark, sf_dir) if r[:2] != (7, "another text under the id of a leak")]
    out = corpus_pipeline.dedup_lines(spark, table(spark, rows).repartition(3), sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pairs(out) == sorted(lines_cut(rows), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert len(lines_of(RUN)) == 5 and (None, f" {RUN} ") in lines_cut(rows) and not any(i == 3 for i, _ in lines_cut(rows))


def pieces_checked(rows):
    assert all(r.lossless and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_encoding_stage_returns_every_row(spark, sf_dir):
    import sentencepiece
    from loomfold.llm.queries import vocabulary

    rows = rows_of(spark, sf_dir)
    out = corpus_pipeline.sample_pieces(spark, table(spark, rows), sf_dir).collect()
    pieces_checked(out)
    assert sorted(map(repr, (r.doc_id for r in out))) == sorted(map(repr, (r[0] for r in rows)))
    model = sentencepiece.SentencePieceProcessor(vocabulary("piece_bpe_32k.model"))
    plain = {i: t for i, t, _ in rows if i and i > 1000 and t.isascii() and "  " not in t and t == t.strip() and "\n" not in t}
    decoded = {r.doc_id: model.decode(list(r.ids)) for r in out if r.doc_id in plain}
    assert decoded == plain and plain


def test_run_equals_its_stages_done_by_hand(spark, sf_dir, tmp_path):
    rows = [r for r in rows_of(spark, sf_dir) if r[0] != 7 or "It is said" in r[1]]
    folder = f"file://{tmp_path}"
    table(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    items = [r.text.lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    known = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1]) and r[0] != 8]
    kept = near_dup_by_brute_force(lines_cut(known))
    clean = [(i, t) for i, t in kept if not any(x in t.lower() for x in items)]
    out = corpus_pipeline.run(spark, folder).collect()
    pieces_checked(out)
    assert sorted(map(repr, (r.doc_id for r in out))) == sorted(map(repr, (i for i, _ in clean)))
    assert {1, 12} <= {r.doc_id for r in out} and not {3, 7, 8, 9, 10, 11} & {r.doc_id for r in out}
