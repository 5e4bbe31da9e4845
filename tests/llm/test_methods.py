"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("loomfold.llm.queries")
from loomfold.llm import decontaminate, fingerprint, language, line_dedup, near_dup, personal_data, piece_sampling, queries, rans, secret_scan, shingles, token_files, toxicity  # noqa: E402
from loomfold.llm.components import connected_components  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_001])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 30_000
    coder = rans.Coder(rans.normalised(np.bincount(np.append(ids, 5), minlength=30_001)))
    code = coder.encode(ids)
    assert np.array_equal(coder.decode(n, **code), ids)
    if n > 10_000:
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
        assert 8 * len(code["words"]) / n < entropy * 1.02


def test_chunked_tokenizer_equals_the_library():
    t = token_files.ChunkedTokenizer(queries.vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB'’,.-3 \n\té—̸́=<|x中 s t re LLŸß") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["don't I'LL 's --'s 12a3 <|endoftext|> <|EndOfText|>", "İstanbul ΣΑΣ ǅ ẞ"]
    assert all(np.array_equal(a, b) for a, b in zip(t.encode(pa.array(texts)), t._ids(texts), strict=True))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_file_gives_the_library_s_ids(name):
    t = token_files.ChunkedTokenizer(queries.vocabulary(name))
    texts = ["Hello  World's 12a3\n", "", "Ünïcödé x", None]
    assert t.chunked == (name == "word_bpe_49k.json")
    assert all(np.array_equal(a, b) for a, b in zip(t.encode(pa.array(texts)), t._ids([x or "" for x in texts]), strict=True))


def test_op1(spark, sf_dir, documents):
    got = queries.op1_token_files(spark, sf_dir).orderBy("doc_id").collect()
    t = token_files.ChunkedTokenizer(queries.vocabulary("word_bpe_49k.json"))
    start = 0
    for r, ids in zip(got, t._ids(documents.text.tolist()), strict=True):
        ids = np.append(ids, 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)


def lines_of(text):
    return [x for x in (y.strip(" \t\n\v\f\r") for y in (text or "").split("\n")) if x]


def repeated(docs, least):
    """Places of lines in runs of ``least`` words that occur earlier without overlap, by brute force."""
    seen, gone = {}, []
    for k, text in enumerate(docs):
        lines = lines_of(text)
        mine = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) >= least:
                    first = seen.setdefault(tuple(lines[a : b + 1]), (k, a))
                    if first[0] != k or first[1] + b - a + 1 <= a:
                        mine.update(range(a, b + 1))
        gone.append(mine)
    return gone


def without(text, gone):
    """The text without the lines at some places among those that aren't blank."""
    kept, place = [], 0
    for line in text.split("\n"):
        blank = not line.strip(" \t\n\v\f\r")
        if blank or place not in gone:
            kept.append(line)
        place += not blank
    return "\n".join(kept)


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 1, 2]))) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, rows[3][1])]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_dedup(lined, least):
    rows, docs = lined
    got = {r.doc_id: (r.text, r.lines_gone) for r in line_dedup.dedup_lines(docs, least_words=least).collect()}
    for (i, text), gone in zip(rows, repeated([t for _, t in rows], least), strict=True):
        assert got[i] == (text if text is None else without(text, gone), len(gone))


def test_maximal_runs(lined):
    rows, docs = lined
    texts, runs = dict(rows), line_dedup.maximal_runs(docs, least_words=4).collect()
    covered = {}
    for r in runs:
        own, first = lines_of(texts[r.d]), lines_of(texts[r.first_d])
        assert own[r.seq : r.seq + r.m] == first[r.first_seq : r.first_seq + r.m] and (r.first_d, r.first_seq) < (r.d, r.seq)
        covered.setdefault(r.d, set()).update(range(r.seq, r.seq + r.m))
    assert [covered.get(i, set()) for i, _ in rows] == repeated([t for _, t in rows], 4)
    # of two copies of a long run there is one maximal run, as long as the common prefix
    text = "\n".join(f"line {i} of a run" for i in range(20))
    (r,) = line_dedup.maximal_runs(docs.sparkSession.createDataFrame([(1, "before\n" + text + "\nafter"), (2, "x\ny\n" + text + "\nz")], "doc_id bigint, text string"), least_words=10).collect()
    assert (r.d, r.seq, r.m, r.first_d, r.first_seq) == (2, 2, 20, 1, 1)


def test_line_counts_replace_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", 7), (2, "a b\nc d", 8)], "doc_id bigint, text string, lines_gone bigint")
    got = {r.doc_id: (r.text, r.lines_gone) for r in line_dedup.dedup_lines(docs, least_words=3).collect()}
    assert got == {1: ("a b\nc d", 0), 2: ("", 2)}


def test_piece_sampling_follows_the_posterior():
    path = queries.vocabulary("piece_bpe_32k.model")
    v = piece_sampling.Vocabulary.load(path)
    size = 8000
    ids, firsts = piece_sampling.encode_slice(v, pa.array(["the"] * size), piece_sampling.row_seeds(pa.array(np.arange(size)), 7))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(firsts[:-1], firsts[1:], strict=True))
    spelled = {bytes(v.spelled[a:b]): i for i, (a, b) in enumerate(zip(v.spelled_from[:-1], v.spelled_from[1:], strict=True)) if i > 258}

    def cuts(x):
        if not x:
            yield ()
        for k in range(1, len(x) + 1):
            if x[:k] in spelled:
                yield from ((spelled[x[:k]], *rest) for rest in cuts(x[k:]))

    weight = {c: math.exp(sum(v.log_p[i] for i in c)) for c in cuts(b" the")}
    total = sum(weight.values())
    assert set(got) <= set(weight)
    assert all(abs(got[c] / size - w / total) < 0.02 for c, w in weight.items())


def test_piece_sampling_is_reproducible_and_lossless(documents):
    path = queries.vocabulary("piece_bpe_32k.model")
    v = piece_sampling.Vocabulary.load(path)
    texts = pa.array(documents.text.tolist()[:60])
    seeds = piece_sampling.row_seeds(pa.array(documents.doc_id.tolist()[:60]), 0)
    ids, firsts = piece_sampling.encode_slice(v, texts, seeds)
    assert piece_sampling.decode_slice(v, ids, firsts).to_pylist() == texts.to_pylist()
    for i in (3, 17, 41):
        own, _ = piece_sampling.encode_slice(v, texts[i : i + 1], seeds[i : i + 1])
        assert np.array_equal(own, ids[firsts[i] : firsts[i + 1]])


PII = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def test_personal_data_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@@++ --()aZ_%é,\n") for _ in range(rng.randint(1, 60)))
        want = []
        for k, p in enumerate(PII):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 16 <= len(d) <= 19 and personal_data.luhn(d), 8 <= len(d) <= 15)[k]
                if ok:
                    want.append((k, m.start(), m.end()))
        assert personal_data.pattern_spans(text) == want


def exact_marginals(field, g):
    unary = np.where(g.possible, field.unary[g.features].sum(axis=1), -1e9)
    weight = np.zeros((5,) * len(unary))
    for labels in np.ndindex(*weight.shape):
        weight[labels] = sum(unary[i, x] for i, x in enumerate(labels)) + sum(field.pair[k][labels[a], labels[b]] for a, b, k in g.edges.tolist())
        if any(o and o != x for o, x in zip(g.observed.tolist(), labels, strict=True)):
            weight[labels] = -np.inf
    p = np.exp(weight - weight.max())
    p /= p.sum()
    return np.stack([p.sum(axis=tuple(j for j in range(len(unary)) if j != i)) for i in range(len(unary))])


@pytest.mark.parametrize("text", ["17 18 zz zz zz zz zz 17", "+1 555-0100 and much later 555-0100 yes", "12 no no no no 7 no no no no 12"])
def test_skip_chain_marginals_are_exact_on_a_tree(text):
    rng = np.random.default_rng(0)
    field = personal_data.Field(rng.normal(size=(int(personal_data._OFFSETS[-1]), 5)), rng.normal(size=(2, 5, 5)))
    field.pair[1] += field.pair[1].T
    for known in ([], [(3, 0, 2)]):
        g = personal_data.graph([text], [known])
        assert len(g.edges) < len(g.observed) and 1 in g.edges[:, 2]
        observed = g.observed > 0
        assert np.allclose(field.marginals(g, tolerance=1e-9)[~observed], exact_marginals(field, g)[~observed], atol=2e-2)


def test_hubs_reach_every_repeat():
    text = " x ".join(["555-0100"] * 40) + " +1 (212) 555-0100"
    g = personal_data.graph([text], [personal_data.pattern_spans(text)])
    hub = int(np.flatnonzero(g.observed)[-1])
    assert {a for a, b, k in g.edges.tolist() if b == hub and k} == set(range(40)) and len(g.edges) < 4 * len(g.observed)


@pytest.fixture(scope="module")
def field():
    table = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    texts = [x for x in table if x and len(x) < 20_000 and personal_data.pattern_spans(x)]
    return personal_data.fit([personal_data.training_graph(x, random.Random(i)) for i, x in enumerate(texts)])


def added(field, *texts):
    base = [personal_data.pattern_spans(x) for x in texts]
    g = personal_data.graph(list(texts), base)
    return [[(personal_data.KINDS[k], x[a:b]) for k, a, b in s] for s, x in zip(personal_data.added_spans(g, field.marginals(g), list(texts), base, 0.5), texts, strict=True)]


FILL = "the house by the river was old and nobody had lived in it for many years "


@pytest.mark.parametrize(
    ("kind", "first", "other"),
    [
        ("phone", "+1 (212) 555-0147", "212-555-0147"), ("phone", "+1 (212) 555-0147", "555-0147"), ("phone", "+1 (212) 555-0147", "212.555.0147"),
        ("card", "4532015112830366", "4532/0151/1283/0366"), ("card", "4532 0151 1283 0366", "4532_0151_1283_0366"), ("ip", "97.51.17.173", "97[.]51[.]17[.]173"),
        ("email", "jo.81@mail7.example.com", "jo.81[at]mail7.example.com"),
    ],
)
def test_the_field_finds_repeats_in_other_writings(field, kind, first, other):
    before, after = f"{FILL}{first} {FILL * 30}{other} {FILL}", f"{FILL}{other} {FILL * 30}{first} {FILL}"
    assert added(field, before, after) == [[(kind, other)], [(kind, other)]]
    many = f"{FILL}{first} " + f"{FILL}{other} " * 50
    assert added(field, many) == [[(kind, other)] * 50]


def test_the_field_adds_nothing_to_other_numbers(field):
    texts = (
        "Version 300.10.0.1 and build 10.0.0.999 and 1.2.3.4567", f"{FILL}+1 (212) 555-0147 {FILL}order 313-555-9921 {FILL}", "Licensed under CC BY-NC 4.0 of 2024-01-15 at 10:30:05",
        f"{FILL}97.51.17.173 {FILL} release 97.51.17 and 97.51.17.1733 {FILL}", "token = \"908038b7daaf91e730d2f64001c52934d43d9336\" and 9807915762804490",
    )
    assert added(field, *texts) == [[]] * len(texts)


@pytest.mark.parametrize(
    "text",
    [
        "tel +1 (212) 555-0147 10:30:05 2024-01-15", "call +1 (212) 555-0147 2024-01-15 10:30 20240115 5550147", "serial 98765550147 and +1 (212) 555-0147", "amount 5,550,147 dollars, +1 (212) 555-0147",
        "10.20.30.40 is dated 10/20/30/40", "97.51.17.173 on 97-51-17 and 1-2-3-4", "+1 (212) 555-0147 in log 2024/01/15 15.01.2024 15-01-2024 12:05:09.123", "+1 (212) 555-0147 costs 212,555.0147 or 1212555",
    ],
)
def test_the_field_adds_no_dates_amounts_or_shared_tails(field, text):
    got = added(field, text, f"{FILL}{text} {FILL * 20}{text}")
    assert {x for spans in got for x in spans} <= {("phone", "+1 (212) 555-0147")}  # where the greedy pattern runs past it


def test_precision_and_recall_of_planted_tokens(field):
    """Repeats in other writings, and look-alikes, each in a document of its own beside what a pattern finds."""
    rng = random.Random(11)
    found = wrong = right = planted = 0
    for n in range(600):
        kind = n % 4
        digits = "".join(str(rng.randrange(10)) for _ in range(10))
        card = digits + digits[:5]
        card += next(str(c) for c in range(10) if personal_data.luhn(card + str(c)))
        first = (f"u{n}@mail{n}.example.org", ".".join(str(rng.randrange(1, 256)) for _ in range(4)), card, f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}")[kind]
        real = n % 8 < 4
        other = personal_data._otherwise_written(kind, first, rng) if real else personal_data._look_alike(kind, first, rng)
        if not real and other in first:
            continue
        got = added(field, f"{FILL}{first} {FILL * rng.randint(1, 9)}{other} {FILL}")[0]
        planted += real
        found += real and (personal_data.KINDS[kind], other) in got
        right += len(got) if real and (personal_data.KINDS[kind], other) in got else 0
        wrong += len(got) - (real and (personal_data.KINDS[kind], other) in got)
    print(f"recall {found}/{planted}, wrong {wrong}, precision {found / max(1, found + wrong):.3f}")
    assert found >= 0.9 * planted and wrong <= 0.05 * found


def test_messages_come_to_rest_where_they_would_swing():
    """A field that pushes neighbours apart round an odd cycle has no rest of its own."""
    text = " ".join(["17"] * 5)
    g = personal_data.graph([text] * 3, [[]] * 3)
    g.edges = np.array([(5 * d + i, 5 * d + j, 0) for d in range(3) for i in range(5) for j in range(i + 1, 5)], np.int64)
    swing = personal_data.Field(np.random.default_rng(1).normal(size=(int(personal_data._OFFSETS[-1]), 5)), np.stack([-30.0 * np.eye(5)] * 2))
    p = swing.marginals(g)
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_the_field_finds_what_a_greedy_pattern_runs_past(field):
    assert added(field, f"{FILL}+1 (826) 555-4081 190.137.223.204 {FILL}") == [[("phone", "+1 (826) 555-4081")]]


def test_op4_base_by_brute_force(spark, sf_dir, documents):
    got = queries.op4_personal_data(spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        want = []
        for k, p in enumerate(PII):
            for m in re.finditer(p, text or ""):
                d = re.sub("[^0-9]", "", m[0])
                if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and personal_data.luhn(d), 8 <= len(d) <= 15)[k]:
                    want.append((k, m.start(), m.end()))
        r = got.loc[i]
        joined = [f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(x[0] == j for x in want) for j in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) == len(want) + r.n_added and set(joined) <= set(spans)


SECRETS = (
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)


def test_secret_spans(spark):
    rng = random.Random(2)
    parts = ["password", "token", "Secret", "API_KEY", "apikey", "=", ": ", '"', "'", "abcdefgh12", "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef" * 4, "a", " ", "é", "\n", "=="]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), f"s{i % 7}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in secret_scan.scan(docs, repository=F.col("source"), owner=F.col("source")).collect()}
    for i, text, _ in rows:
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(SECRETS) for m in re.finditer(p, text) if ok(m))
        want = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text


def test_bare_copies_of_live_secrets_are_added(spark):
    from pyspark.sql import functions as F

    key = "q8Zk1Lm0Pq7Rt5Vw3Xy9"
    rows = [(1, f"token={key}", "a"), (2, f"see {key} here", "a")] + [(10 + i, "token=COPIED123456EXAMPLE9", f"o{i}") for i in range(9)] + [(30, "COPIED123456EXAMPLE9", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan(docs, repository=F.col("source"), owner=F.col("source")).collect()}
    assert got[2].spans == "value:4:24" and got[1].live == "assign:0:26" and got[30].spans == "" and got[10].live == ""


def scanned(spark, rows, **options):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(rows)], "doc_id bigint, text string, source string")
    found = secret_scan.scan(docs, repository=F.col("source"), owner=F.split("source", "/")[0], **options)
    return [found.where(f"doc_id = {i}").first() for i in range(len(rows))]


def test_bare_values_are_found_short_dotted_and_glued(spark):
    dotted = "ab12.cd34-secretvalue99"
    rows = [("password=hunter42x and", "a/r"), (f'secret: "{dotted}"', "b/r"), ("I typed hunter42x. Then", "c/r"), (f"HOST={dotted} x", "c/s"), ("a/hunter42x/b?k=hunter42x", "d/r"), ("hunter42xyz 2hunter42x", "d/r")]
    got = scanned(spark, rows)
    assert [r.spans for r in got] == ["assign:0:18", f"assign:0:{9 + len(dotted)}", "value:8:17", f"value:5:{5 + len(dotted)}", "value:2:11,value:16:25", ""]


def test_ownership_counts_owners_and_repositories(spark):
    forks = [("token=forkedkey12345", f"one/r{i}") for i in range(4)]
    copies = [("token=copiedkey12345", f"o{i}/r") for i in range(4)]
    bare = [("copiedkey12345 forkedkey12345", "z/z")]
    *_, last = scanned(spark, forks + copies + bare, most_repositories=5)
    assert last.spans == last.live == "value:15:29"
    got = scanned(spark, forks + copies + bare, most_repositories=3)
    assert got[-1].spans == "" and all(r.copied == "assign:0:20" and r.live == "" for r in got[:-1])


def test_secret_scan_is_linear_in_a_text(spark):
    import time

    def took(n):
        text = " ".join(f"token=v{i:07d} w{i:07d}x" for i in range(n))
        began = time.time()
        (r,) = scanned(spark, [(text, "a/b")])
        assert r.n_assign == n and r.spans.startswith("assign:0:14,assign:25:39")
        return time.time() - began

    took(100)
    assert took(16_000) < 10 + 6 * took(4_000)


def test_language_accuracy(spark, sf_dir, documents):
    got = queries.op5_language_id(spark, sf_dir).where("held_out").toPandas().merge(documents[["doc_id", "lang"]], on="doc_id")
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_bloom_filters_return_all_languages():
    rng = np.random.default_rng(1)
    sets = {f"l{i:02d}": rng.integers(0, 1 << 63, 500).astype(np.uint64) for i in range(70)}
    f = language.Filters.build(sets)
    for name in ("l00", "l63", "l64", "l69"):
        i = f.languages.index(name)
        assert ((f.masks(sets[name], i // 64) >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert f.false_positive_rates().max() < 0.01


def test_every_seen_gram_is_in_its_languages_and_counts_are_corrected(spark):
    from pyspark.sql import functions as F

    texts = {"aa": ["abcd efgh", "efgh ijkl"], "bb": ["efgh mnop"]}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in texts.items() for t in v)], "doc_id bigint, text string, lang string")
    f = language.learn(docs, F.lit(True))

    def seen(text):
        return {text[i : i + 4] for i in range(len(text) - 3)}

    members = {k: set().union(*map(seen, v)) for k, v in texts.items()}
    assert f.languages == ["aa", "bb"] and f.left_out == {"aa": 0.0, "bb": 0.0}
    text = "efgh mnop qrst abcd"
    grams = [text[i : i + 4] for i in range(len(text) - 3)]
    hashes, _ = language.grams(*language.utf8(pa.array([text])))
    assert f.masks(hashes, 0).tolist() == [sum(1 << i for i, k in enumerate(("aa", "bb")) if g in members[k]) for g in grams]
    rates = np.array([0.05, 0.1])  # the correction is of the rates given
    corrected = [max(0.0, (sum(g in members[k] for g in grams) - len(grams) * r) / (1 - r)) for k, r in zip(("aa", "bb"), rates, strict=True)]
    names, score, explained = f.predict(pa.array([text]), rates)
    best = int(np.argmax(corrected))
    assert names == [f.languages[best]] and np.isclose(score[0], corrected[best] / sum(corrected)) and np.isclose(explained[0], corrected[best] / len(grams))


def test_small_filters_keep_the_most_frequent(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "aaaa aaaa bbbb", "xx")], "doc_id bigint, text string, lang string")
    f = language.learn(docs, F.lit(True), per_language=2)  # two n-grams occur twice, seven once
    assert np.isclose(f.left_out["xx"], 7 / 11)


def test_language_ties_go_to_the_first_by_name(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "same text", "zz"), (2, "same text", "yy")], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in language.identify(docs, language.learn(docs, F.lit(True))).collect()} == {"yy"}


def test_decontamination_finds_all_leaks(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    want = {(d, i) for i, x in zip(items.item_id, items.text, strict=True) for d, t in zip(documents.doc_id, documents.text, strict=True) if x.lower() in t.lower()}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontaminate(spark, sf_dir).collect()}
    assert want and want <= got and len(got - want) <= 1


def test_shards_change_no_result(spark, sf_dir, monkeypatch):
    once = sorted(map(tuple, queries.op7_decontaminate(spark, sf_dir).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1 << 11)
    monkeypatch.setattr(decontaminate, "SHARDS_A_PASS", 6)
    again = sorted(map(tuple, queries.op7_decontaminate(spark, sf_dir).collect()))
    assert once and [r[:2] for r in once] == [r[:2] for r in again] and np.allclose([r[2:] for r in once], [r[2:] for r in again])


def test_wand_equals_full_bm25():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 15)))) for i in range(40)]
    texts = [" ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))), rng.choice(items)[1]]) for _ in range(60)]
    hashed = {i: decontaminate.hashed_words(pa.array([t]))[0].tolist() for i, t in items}
    df = Counter(h for x in hashed.values() for h in set(x))
    idf = {int(np.uint64(h).view(np.int64)): math.log(1 + (40 - n + 0.5) / (n + 0.5)) for h, n in df.items()}
    index = decontaminate.Index.build(items, idf, np.mean([len(x) for x in hashed.values()]), max(len(x) for x in hashed.values()))
    h, firsts = decontaminate.hashed_words(pa.array(texts))
    got = {(r, s, i): x for r, s, _, i, x in index.candidates(h, firsts, 0.5)}
    mean = np.mean([len(x) for x in hashed.values()])

    def part(i, terms):
        x = hashed[i]
        return sum(idf[int(np.uint64(t).view(np.int64))] * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(x) & terms)

    want = {}
    for row in range(len(texts)):
        for s in range(int(firsts[row]), max(int(firsts[row]) + 1, int(firsts[row + 1])), index.longest):
            terms = set(h[s : min(s + 2 * index.longest, firsts[row + 1])].tolist())
            for i, _ in items:
                if (x := part(i, terms) / part(i, set(hashed[i]))) >= 0.5 + 1e-9:
                    want[row, s, i] = x
    assert set(want) <= set(got) and all(abs(got[k] - x) < 1e-6 for k, x in want.items())


def brute_components(docs, size, percent):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows = []
    for family in range(12):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, size=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 12)
    rng = random.Random(9)
    core = [f"c{i}" for i in range(103)]
    texts = [core + [f"own{i}x{k}" for k in range(20)] for i in range(60)]  # boilerplate with words of their own
    texts += [core + [rng.choice("abcdef") for _ in range(rng.randint(8, 22))] for _ in range(90)]  # and without
    rows = list(enumerate(map(" ".join, texts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, size=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_own_shingles_bound_similarity(spark):
    sets = {1: [1, 2, 3], 2: [2, 3, 4], 3: [9], 4: [3, 9, 10, 11]}
    held = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "rep bigint, held binary")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "rep bigint, n_shingles bigint")
    got = {r.rep: r.common for r in near_dup.without_own_shingles(sizes.where("rep != 2"), held, sizes).collect()}
    assert got == {1: 1, 3: 1, 4: 2}


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(30)]
    left, right = rng.integers(0, 30, 200), rng.integers(0, 30, 200)
    got = near_dup.overlaps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), left, right)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)]


def test_minhash_estimates_jaccard():
    a, b = " ".join(f"a{i}" for i in range(1000)), " ".join(f"a{i}" for i in range(200, 1200))
    rows, h = shingles.shingles(pa.array([a, b]), 4)
    firsts = np.searchsorted(rows, np.arange(3))
    sig = shingles.signatures(h, firsts, 512)
    assert abs((sig[0] == sig[1]).mean() - 797 / 1197) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(60)) and got[100] == 0


def test_non_negative_risk_and_its_slope():
    rng = np.random.default_rng(3)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for prior, shift in ((0.1, 0.0), (0.6, 0.0), (0.6, 4.0)):
        positive = rng.random(40) < 0.4
        z = rng.normal(size=40) + shift * positive

        def parts(v):
            p = [sigmoid(a) for a, k in zip(v, positive, strict=True) if k]
            u = [sigmoid(a) for a, k in zip(v, positive, strict=True) if not k]
            return prior * sum(1 - a for a in p) / len(p), sum(u) / len(u) - prior * sum(p) / len(p)

        plus, minus = parts(z)
        risk, slope = toxicity.risk_and_slope(z, positive, prior)
        assert np.isclose(risk, plus + max(0.0, minus))
        for i in range(0, 40, 7):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            a, b = parts(up), parts(down)
            want = (sum(a) - sum(b)) / 2e-5 if minus >= 0 else -(a[1] - b[1]) / 2e-5
            assert np.isclose(slope[i], want, atol=1e-6)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.01").where("held_out").toPandas().merge(labels, on="doc_id")
    assert got[got.toxic == 0].predicted.mean() < 0.1 and got[got.toxic == 1].predicted.mean() >= 0.5


def test_fingerprints(spark, sf_dir, documents):
    got = queries.op10_fingerprints(spark, sf_dir).toPandas().set_index("doc_id")
    texts = documents.set_index("doc_id").text
    order = sorted(texts.index, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        k = len(texts[i]) // 3
        want = texts[i][: len(texts[i]) - k] + texts[after][:k]
        assert got.loc[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got.loc[i].n_chars == len(texts[i])
        assert got.loc[i].edited_fingerprint == fingerprint.encode(fingerprint.digests_of([want]))[0]
    assert (got.near_edited > got.near_next).mean() > 0.95
