"""The corpus pipeline: five stages over ``documents``, each an operator of loomfold.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, extra ones included. Rows are kept or dropped one by one;
a doc_id may repeat, and null ids are judged like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm import decontaminate, language, line_dedup, near_dup, piece_sampling
from loomfold.llm.queries import vocabulary
from loomfold.llm.storage import materialize
from loomfold.llm.textio import free_name

#: Least share of n-grams known in the language, where labelled documents are too few to derive one.
LEAST_EXPLAINED = 0.02
#: Numbers of n-grams from which shares are derived apart; texts under the first, about five words, are too short to tell.
LENGTHS = (32, 128, 512)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, as doc_id may repeat or be null, and its column; written once so that all plans see the same."""
    row = free_name("_loom_row", docs.columns)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _by_row(numbered: DataFrame, row: str) -> DataFrame:
    """The texts, with the row's number in place of the doc_id."""
    return numbered.select(F.col(row).alias("doc_id"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters go, and those long enough to tell with far fewer known n-grams than usual.

    Null and empty texts have no letters. Rows are judged by their own text, so repeated rows
    and null ids change nothing; where no document has a language all stay, as in an empty table.
    """
    filters, halves = language.learn_halves(docs)
    if not filters.languages:  # nothing to learn from, so nothing to reject by
        return docs
    least = language.least_shares(docs, filters, halves, LENGTHS, floor=LEAST_EXPLAINED)
    return language.in_known_language(docs, filters, least, LENGTHS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; a document goes when nothing else was in it.

    A column n_chars, in any case, counts what is left. Null and empty texts stay; see :mod:`loomfold.llm.line_dedup`.
    """
    gone = free_name("_loom_gone", docs.columns)
    cleaned = line_dedup.dedup_lines(docs, count_as=gone)
    emptied = (F.col(gone) > 0) & ~F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    for c in (c for c in docs.columns if c.lower() == "n_chars"):
        cleaned = cleaned.withColumn(c, F.when(F.col(gone) > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)))
    return cleaned.where(~emptied).drop(gone)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, with a null one only if all are.

    Texts without words are near nothing; of those equal in doc_id and text one row stays.
    """
    rows, row = _numbered(docs)
    found = near_dup.near_duplicates(_by_row(rows, row), size=5, percent=80).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    blank = F.when(~F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.col("text"))
    named = found.join(rows.select(row, F.col("doc_id").cast("bigint").alias("id"), blank.alias("blank"), F.col("text").isNull().alias("absent")), row)
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless, F.col("component_id")).alias("component"), *(F.when(wordless, F.col(c)).alias(f"of_{c}") for c in ("id", "blank", "absent"))]
    first = named.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", row)).alias("first"))
    kept = materialize(first.select(F.col(f"first.{row}").alias("kept")), "kept")
    return rows.join(kept, rows[row] == kept["kept"], "left_semi").drop(row)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null and empty texts have none and stay, as all do where the benchmark is empty; each row is
    judged by its own text, whatever its doc_id. See :mod:`loomfold.llm.decontaminate`.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row = _numbered(docs)
    leaks = materialize(decontaminate.matches(_by_row(rows, row), items).select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return rows.join(leaks, rows[row] == leaks["leak"], "left_anti").drop(row)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the sampled piece ids, their checksum, and whether they decode to the text.

    Null and empty texts have no pieces; every row gives one, also those that repeat or have no id.
    """
    found = piece_sampling.round_trip(docs, vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_crc32", "ids", "lossless")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_benchmark),
    ("SentencePiece encoding", sample_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else materialize(out, f"stage{k}")
    return docs


#: No SQL expresses all stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None
