"""Rows of the pipeline's stages on short documents, repeated rows, clashing and null ids."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loomfold.llm import near_dup  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


@pytest.fixture(scope="module")
def prose(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(120).collect()
    return [(1000 + r.doc_id, r.text, r.lang) for r in rows]


def test_language_keeps_short_documents(spark, sf_dir, prose):
    rng = random.Random(3)
    noise = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(3000))
    short = [(1, "Re.", "en"), (2, "A.", "en"), (3, "De.", "fr"), (4, "Zq", "en"), (5, "Nnoughe.", "en")]
    bad = [(6, "12 345", "en"), (7, noise, None), (8, None, "en"), (9, "漢字" * 40, None)]
    out = corpus_pipeline.identify_language(spark, table(spark, prose + short + bad), sf_dir)
    assert pairs(out) == pairs(table(spark, prose + short))


def shingle_set(text, size=5):
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_dup_by_brute_force(rows):
    """One (doc_id, text) of each component of rows: the smallest doc_id's."""
    sets, root = [shingle_set(t or "") for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            same = rows[x] == rows[y]
            if same or sets[x] and sets[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    groups = {}
    for x, row in enumerate(rows):
        groups.setdefault(find(x), []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
REPEATED = [
    (4, LINE, "en"), (4, LINE, "en"), (4, LINE, "en"), (3, LINE + " nu", "en"), (None, LINE, "en"), (None, "one lone row", "en"), (None, "one lone row", "en"),
    (5, "first text of id five", "en"), (5, "quite another text of the same id", "en"), (6, "quite another text of the same id", "en"), (7, "", "en"), (7, "", "en"), (7, None, "en"),
    (7, None, "en"), (8, "", "en"), (None, "", "en"), (None, "", "en"), (None, None, "en"), (9, "Re.", "en"), (9, "Re.", "en"), (9, "A.", "en"),
]


def test_near_dedup_keeps_one_row_of_a_group(spark, sf_dir):
    out = corpus_pipeline.dedup_documents(spark, table(spark, REPEATED), sf_dir)
    assert pairs(out) == sorted(near_dup_by_brute_force([r[:2] for r in REPEATED]), key=repr)


def test_language_judges_rows_not_ids(spark, sf_dir, prose):
    rows = [(None, "123 456", "en"), (None, "Re.", "en"), (7, "123 456", "en"), (7, "A.", "en")]
    out = corpus_pipeline.identify_language(spark, table(spark, prose + rows), sf_dir)
    assert pairs(out) == pairs(table(spark, [*prose, rows[1], rows[3]]))


def test_decontamination_judges_rows_not_ids(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, item, "en"), (1, "a clean text under the same id", "en"), (None, f"before it {item} after it", "en"), (None, "a clean text without an id", "en"), (2, "Re.", "en"), (2, "Re.", "en")]
    out = corpus_pipeline.decontaminate_benchmark(spark, table(spark, rows), sf_dir)
    assert pairs(out) == sorted([(1, rows[1][1]), (None, rows[3][1]), (2, "Re."), (2, "Re.")], key=repr)


POLISH = (
    "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie. "
    "Panno święta, co jasnej bronisz Częstochowy i w Ostrej świecisz Bramie, ty, co gród zamkowy nowogródzki ochraniasz z jego wiernym ludem, jak mnie dziecko do zdrowia powróciłaś cudem, "
    "gdy od płaczącej matki pod twoją opiekę ofiarowany, martwą podniosłem powiekę i zaraz mogłem pieszo do twych świątyń progu iść za wrócone życie podziękować Bogu, tak nas powrócisz cudem na ojczyzny łono. "
    "Tymczasem przenoś moję duszę utęsknioną do tych pagórków leśnych, do tych łąk zielonych, szeroko nad błękitnym Niemnem rozciągnionych."
)


def test_language_rejects_languages_that_were_not_learned(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = spark.createDataFrame([(-1, POLISH)], "doc_id bigint, text string").join(docs.drop("doc_id", "text").limit(1).drop("lang")).selectExpr("*", "cast(null as string) as lang")
    out = corpus_pipeline.identify_language(spark, docs.unionByName(foreign), sf_dir)
    assert pairs(out) == pairs(docs)


def test_near_duplicates_of_every_text_of_one_id(spark):
    rng = random.Random(4)
    bases = [[f"{k}w{rng.randint(0, 400)}" for _ in range(60)] for k in range(40)]
    rows, want = [], {}
    for k in range(0, 40, 2):  # two texts under one id, and a near copy of each under others
        for j, base in enumerate(bases[k : k + 2]):
            rows += [(k, " ".join(base)), (100 + k + j, " ".join(base[:-1]))]
        want |= {k: k, 100 + k: k, 101 + k: k}
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4).collect()
    assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_clashing_columns_pass_through_all_stages(spark, sf_dir, prose):
    names = ["_loom_gone", "_LOOM_ROW", "_loom_d", "_loom_t", "_loom_runs", "_loom_kept", "_loom_leak", "_loom_row_"]
    run = "\n".join(" ".join(f"w{k}x{j}" for j in range(14)) for k in range(5))
    rows = prose + [(1, f"one start of its own\n{run}", "en"), (2, f"{run}\nan end of its own", "en"), (2, f"{run}\nan end of its own", "en")]
    docs = table(spark, rows).withColumnRenamed("n_chars", "N_CHARS")
    docs = docs.selectExpr("*", *(f"concat('{c}', coalesce(doc_id, 0)) as {c}" for c in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) > len(prose) / 2
        for r in found:
            assert all(r[c] == f"{c}{r.doc_id}" for c in names) and r.N_CHARS == len(r.text)
        docs = out
    assert [r.text for r in found if r.doc_id == 2] == ["an end of its own"]
