"""Every operator and stage on nulls, empty and very long texts, repeats, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loomfold.llm import decontaminate, fingerprint, language, line_dedup, near_dup, personal_data, piece_sampling, secret_scan, token_files, toxicity  # noqa: E402
from loomfold.llm.queries import vocabulary  # noqa: E402
from loomfold.llm.storage import fresh_path  # noqa: E402

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id bigint, kept boolean, lang_pred string, "
    "lines_gone bigint, row bigint, ids string, runs string, n_shingles bigint, d bigint, t bigint, label int"
)
LONG = "word " * 60_000 + "x" * 5_000
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen"
TEXTS = [
    (None, COPY), (1, None), (2, ""), (3, LONG), (4, COPY), (4, COPY), (5, COPY + " extra"), (6, "   \n\t "), (7, "12345 67890"), (8, "Ünïcödé ▁ 😀 text"),
    (9, "password=abcdef123456 me@mail.example.com 10.0.0.1 +1 (212) 555-0100 and 4532015112830366"), (10, "the quick brown fox"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rest = (None,) * 12
    rows = [(i, x, "en" if i != 7 else None, None if i == 2 else "src1", None if x is None else len(x), *rest) for i, x in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def n(df):
    return len(df.collect())


def test_token_files(spark, docs, empty):
    for table, size in ((docs, len(TEXTS)), (empty, 0)):
        folder = fresh_path(spark, "t")
        token_files.write(table, folder, vocabulary("word_bpe_49k.json"))
        rows = token_files.read(spark, folder, with_ids=True).orderBy("start").collect()
        assert len(rows) == size
        assert all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in rows)
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(size)]
        if size:
            assert [r.doc_id for r in rows] == [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, None]
            assert rows[0].ids == [1] == rows[1].ids


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs, least_words=5, count_as=None)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    assert (None, COPY) in got and (4, "") in got and (5, COPY + " extra") in got and (1, None) in got
    assert n(line_dedup.dedup_lines(empty)) == 0


def test_near_dup(docs, empty):
    rows = near_dup.near_duplicates(docs, size=4).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[1].n_shingles == by[2].n_shingles == by[6].n_shingles == 0 and by[1].kept
    assert next(r for r in rows if r.doc_id is None).kept
    assert n(near_dup.near_duplicates(empty)) == 0


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, COPY), (2, None), (None, COPY), (3, ""), (4, COPY)], "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs.where("doc_id is not null"), items).collect())
    assert found == [(4, 1), (4, 1), (4, 4), (4, 4), (5, 1), (5, 4)]
    assert n(decontaminate.matches(docs, items.limit(0))) == 0 == n(decontaminate.matches(empty, items))


def test_language(docs, empty):
    filters = language.learn(docs, F.lit(True))
    rows = language.identify(docs, filters).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred == by[2].lang_pred == by[7].lang_pred == "und" and by[1].score == 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in language.identify(docs, language.learn(empty, F.lit(True))).collect())


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert n(toxicity.score(empty, toxicity.train(empty, labels.limit(0), F.lit(True)))) == 0


def test_personal_data(docs, empty):
    rows = {r.doc_id: r for r in personal_data.scan(docs, personal_data.train(docs)).collect()}
    r = rows[9]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert rows[1].spans == rows[2].spans == ""
    assert n(personal_data.scan(empty, personal_data.train(empty))) == 0


def test_secrets(docs, empty):
    run = lambda d: secret_scan.scan(d, repository=F.col("source"), owner=F.col("source"))
    rows = {r.doc_id: r for r in run(docs).collect()}
    assert rows[9].n_assign == 1 and rows[9].spans == "assign:0:21" and rows[1].spans == ""
    assert n(run(docs)) == len(TEXTS) and n(run(empty)) == 0


def test_fingerprints(docs, empty):
    rows = fingerprint.compare_with_edits(docs).collect()
    assert len(rows) == len(TEXTS)
    same = {r.fingerprint for r in rows if r.doc_id == 4 or r.doc_id is None}
    assert len(same) == 1 and len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert n(fingerprint.compare_with_edits(empty)) == 0


def test_pieces(docs, empty):
    path = vocabulary("piece_bpe_32k.model")
    encoded = piece_sampling.encode(docs, path)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text)
    texts = sorted(piece_sampling.decode(encoded, path).collect(), key=key)
    assert [r.text for r in texts] == [t or "" for _, t in sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]
    rows = piece_sampling.round_trip(docs, path).collect()
    assert len(rows) == len(TEXTS) and all(r.lossless for r in rows)
    assert sorted(r.ids_crc32 for r in rows) == sorted(r.ids_crc32 for r in encoded.collect())
    for run in (piece_sampling.encode, piece_sampling.round_trip):
        assert n(run(empty, path)) == 0
    assert n(piece_sampling.decode(encoded.limit(0), path)) == 0


def test_stages(spark, docs, empty, sf_dir):
    for table in (docs, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, sf_dir)
            if k < 4:
                assert out.columns == table.columns
            out.collect()
