"""The registered queries over the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html_text, language, lexical_search, line_dedup, near_dup, personal_data, piece_sampling, secret_scan, source_audit, token_files, toxicity
from .storage import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lines_gone", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_sampling.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return personal_data.scan(docs, personal_data.train(docs))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = language.learn(docs, _fold(3) != 1)
    return language.identify(docs, filters).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    repository = F.col("source").cast("string")
    return secret_scan.scan(_table(spark, sf_dir, "documents"), repository=repository, owner=F.element_at(F.split(repository, "/"), 1))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), _fold(5) != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages)).select("page_id", "url", "text", "n_chars")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"), least_docs=30, top_terms=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_line_dedup": op2_line_dedup,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_personal_data": op4_personal_data,
    "op5_language_id": op5_language_id,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_html_text": op11_html_text,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_audit": op13_source_audit,
}


def _secret_spans_sql(place: int, pattern: str, value: str = "found", extra: str = "true") -> str:
    """Spans of a pattern: the pieces and matches before a match give its place."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT row, {place} AS place, st AS a, st + length(found) AS b, {value.format(p=p)} AS v FROM (
  SELECT row, found, CAST(sum(length(piece) + length(found)) OVER (PARTITION BY row ORDER BY j) - length(found) AS INTEGER) AS st FROM (
    SELECT row, unnest(m) AS found, unnest(pieces[1:len(m)]) AS piece, unnest(range(1, len(m) + 1)) AS j FROM (
      SELECT row, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS pieces FROM d))) WHERE length({value.format(p=p)}) >= 8 AND {extra}"""


_ENDS = f"'{secret_scan.ENDS}'"
_PIECES_SQL = " UNION ".join(
    f"SELECT row, place, a + CAST(length(v) - length(ltrim(v, {_ENDS})) AS INTEGER) AS a, b - CAST(length(v) - length(rtrim(v, {_ENDS})) AS INTEGER) AS b, trim(v, {_ENDS}) AS v FROM ("
    + _secret_spans_sql(3, f"[0-9{alphabet}]{{8,}}", extra="regexp_matches(found, '[0-9]')")
    + f") WHERE length(trim(v, {_ENDS})) >= 8"
    for alphabet, _ in secret_scan.ALPHABETS
)
_SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS repository, split_part(coalesce(source, ''), '/', 1) AS owner, coalesce(text, '') AS t FROM documents),
base AS ({_secret_spans_sql(0, secret_scan.ASSIGN, "regexp_extract(found, {p}, 2)")} UNION ALL {_secret_spans_sql(1, secret_scan.ACCESS)} UNION ALL {_secret_spans_sql(2, secret_scan.HEX)}),
owned AS (SELECT w, min(v) AS v, n_o <= 2 AND n_r <= 20 * n_o AS few FROM (
  SELECT w, v, count(DISTINCT owner) OVER (PARTITION BY w) AS n_o, count(DISTINCT (owner, repository)) OVER (PARTITION BY w) AS n_r FROM (SELECT *, trim(v, {_ENDS}) AS w FROM base) JOIN d USING (row)) GROUP BY w, n_o, n_r),
live AS (SELECT w FROM owned WHERE few AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(lower(v), 'example|sample|placeholder|changeme|xxxx')
  AND len(list_filter(range(1, length(v) - 4), lambda i: lower(substr(v, i, 6)) = repeat(lower(substr(v, i, 1)), 6))) = 0),
pieces AS ({_PIECES_SQL}),
bare AS (SELECT DISTINCT t.* FROM pieces t WHERE t.v IN (SELECT w FROM live) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND b.a < t.b AND t.a < b.b)),
added AS (SELECT t.* FROM bare t WHERE NOT EXISTS (SELECT 1 FROM bare o WHERE o.row = t.row AND o.a <= t.a AND t.b <= o.b AND o.b - o.a > t.b - t.a)),
spans AS (SELECT *, ['assign', 'access', 'hex', 'value'][place + 1] || ':' || a || ':' || b AS s, trim(v, {_ENDS}) IN (SELECT w FROM live) AS is_live, trim(v, {_ENDS}) IN (SELECT w FROM owned WHERE NOT few) AS is_copied
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
joined AS (
  SELECT row, count(*) FILTER (WHERE place = 0) AS n0, count(*) FILTER (WHERE place = 1) AS n1, count(*) FILTER (WHERE place = 2) AS n2,
    string_agg(s, ',' ORDER BY a, place, b) FILTER (WHERE place < 3) AS base, string_agg(s, ',' ORDER BY a, place, b) AS spans, string_agg(s, ',' ORDER BY a, place, b) FILTER (WHERE is_live) AS live,
    string_agg(s, ',' ORDER BY a, place, b) FILTER (WHERE is_copied) AS copied
  FROM spans GROUP BY row)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(live, '') AS live, coalesce(copied, '') AS copied FROM d LEFT JOIN joined USING (row)
"""

ORACLES: dict[str, str] = {
    "op6_secrets": _SECRETS_SQL,
    "op8_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.other FROM reach r JOIN (SELECT a AS one, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON l.one = r.seen
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.seen) AS component_id, min(r.seen) = s.doc_id AS kept
FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
""",
    # of the layout that the given pages have; tests hold other layouts
    "op11_html_text": r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM c)
""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n),
scored AS (SELECT q.item_id, t.row, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * s.n) // s.l)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN weights USING (term) JOIN d USING (row), s GROUP BY q.item_id, t.row),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN d USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.lang_n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (k.lang_n + 5)) // (v.total + 5 * v.v) AS BIGINT) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 50
""",
}
