"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the matches of fixed patterns. Their values' hashes are counted by
distinct repositories and owners over the whole corpus. A value that more than
``most_owners`` owners carry, or that stands in more than ``most_repositories``
repositories for each of its owners, is a copied example; one below both that has
a digit and is no placeholder is live. Live values are then also found where no
pattern announces them (kind ``value``): bare in any document, outside the
candidates' spans.

Values count without the dots, dashes and other marks of their alphabet at their
ends. A bare occurrence is a whole run of that alphabet, or one of the pieces into
which ``=``, ``=`` and ``/``, or ``=``, ``/`` and ``.`` cut a run, so that it is
found in ``NAME=value``, in a path or at the end of a sentence. It has LEAST_VALUE
characters or more and a digit. Of occurrences in one another the longest counts.

The text is read once; what is kept of it are candidates and pieces with a digit,
located by the summed lengths of what ``split`` leaves between matches, in time
proportional to the text. Nulls are empty texts; repeated rows are told apart, as
are rows with null or repeated ids. A null repository or owner counts as one
without a name. An empty table gives no rows. Of the table only doc_id, text and
what the two expressions name is read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Fixed patterns; kinds are listed in the order in which spans at one place stand.
KINDS = ("assign", "access", "hex", "value")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|xxxx|(.)\1{5}"
LEAST_VALUE = 8
#: The alphabets of bare occurrences, without digits: with all marks, and each without one more, which then cuts.
ALPHABETS = (("A-Za-z+/_.=-", ""), ("A-Za-z+/_.-", "="), ("A-Za-z+_.-", "/"), ("A-Za-z+_-", "."))
#: Marks that don't count at a value's ends.
ENDS = "+/_.=-"
#: Matches whose places are summed at once.
BLOCK = 256
_PLACES = "array<struct<start:int,found:string>>"
_SPANS = "array<struct<start:int,place:int,end:int>>"


def bare(alphabet: str, cut: str) -> str:
    """Whole runs of an alphabet with a digit, beside ``cut`` if given; a run is tried from its start only."""
    run = f"[{alphabet}]*+[0-9][0-9{alphabet}]*+"
    return f"(?<![0-9{alphabet}])(?:(?<=[{cut}]){run}|{run}(?=[{cut}]))" if cut else f"(?<![0-9{alphabet}]){run}"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, found) of leftmost non-overlapping matches, in code points.

    A match starts where the pieces and matches before it end. Sums run within
    blocks of matches, so that no array grows match by match over a whole text.
    """
    none = F.array().cast(_PLACES)

    def width(p: Column) -> Column:
        return p["before"] + F.length(p["found"])

    def place(at: Column, block: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            one = F.struct((s["at"] + p["before"]).alias("start"), p["found"].alias("found"))
            return F.struct((s["at"] + width(p)).alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def begin(s: Column, block: Column) -> Column:
        total = F.aggregate(block, s["at"], lambda n, p: n + width(p))
        return F.struct(total.alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), begin, lambda s: s["starts"])
        return F.flatten(F.zip_with(starts, blocks, place))

    def in_blocks(pairs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        return _bound(F.transform(blocks, lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK)), placed)

    def paired(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), F.length)
        pairs = F.slice(F.zip_with(found, between, lambda m, n: F.struct(m.alias("found"), n.alias("before"))), 1, F.size(found))
        return F.when(F.size(found) > 0, _bound(pairs, in_blocks)).otherwise(none)

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


def _spans(found: Column, kind: str) -> Column:
    place = KINDS.index(kind)

    def one(x: Column) -> Column:
        v = F.regexp_extract(x["found"], ASSIGN, 2) if kind == "assign" else x["found"]
        return F.struct(x["start"].alias("start"), F.lit(place).alias("place"), (x["start"] + F.length(x["found"])).alias("end"), v.alias("value"))

    return F.filter(F.transform(found, one), lambda s: F.length(s["value"]) >= LEAST_VALUE)


def _pieces(text: Column) -> Column:
    """Bare pieces under all alphabets, without marks at their ends."""

    def one(x: Column) -> Column:
        value = F.btrim(x["found"], F.lit(ENDS))
        start = x["start"] + F.length(x["found"]) - F.length(F.ltrim(x["found"], F.lit(ENDS)))
        return F.struct(start.alias("start"), F.lit(KINDS.index("value")).alias("place"), (start + F.length(value)).alias("end"), value.alias("value"))

    found = F.concat(*(_located(text, bare(*a)) for a in ALPHABETS))
    return F.filter(F.transform(found, one), lambda s: F.length(s["value"]) >= LEAST_VALUE)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))))


def _hash(value: Column) -> Column:
    return F.sha2(F.btrim(value, F.lit(ENDS)), 256)


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row for each document: its candidates' spans and its bare pieces."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), repository.alias("repository"), owner.alias("owner"), text.alias("text"))
    out = rows.select(
        "doc_id", "repository", "owner", *(_spans(_located(F.col("text"), p), k).alias(k) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))),
        _pieces(F.col("text")).alias("pieces"),
    )
    return out.withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """value hash, number of distinct repositories and of distinct owners, and a value."""
    each = found.select("repository", "owner", F.explode(F.concat("assign", "access", "hex")).alias("s"))
    each = each.select(_hash(F.col("s.value")).alias("hash"), F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"), F.col("s.value").alias("value"))
    each = each.groupBy("hash", "owner", "repository").agg(F.min("value").alias("value"))
    each = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.min("value").alias("value"))
    return each.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.min("value").alias("value"))


def scan(docs: DataFrame, *, repository: Column, owner: Column, most_owners: int = 2, most_repositories: int = 20) -> DataFrame:
    """doc_id, counts and spans of every row.

    ``spans`` has the candidates and the added bare occurrences of live values;
    ``live`` those of them whose value is live, ``copied`` the candidates whose
    value is a copied example.
    """
    found = materialize(candidates(docs, repository, owner), "secrets")
    few = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories * F.col("n_owners"))
    owned = ownership(found).select("hash", (few & F.col("value").rlike("[0-9]") & ~F.col("value").rlike(PLACEHOLDER)).alias("is_live"), (~few).alias("is_copied")).where("is_live or is_copied")
    is_base = F.col("place") < KINDS.index("value")
    base = F.concat("assign", "access", "hex")
    spans = found.select("row", F.explode(F.concat(base, "pieces")).alias("s")).select("row", "s.start", "s.place", "s.end", _hash(F.col("s.value")).alias("hash"))
    known = spans.join(owned, "hash", "left").where(is_base | F.col("is_live")).drop("hash")
    # spans of a document by start, longer ones first: what overlaps a candidate or lies in a longer piece is no further span
    rows = Window.partitionBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before, after = rows.orderBy("start", F.desc("end")), rows.orderBy(F.desc("start"), "end")
    clear = ~F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) & ~F.coalesce(F.min(F.when(is_base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    known = known.withColumn("added", ~is_base & clear)
    known = known.withColumn("added", F.col("added") & ~F.coalesce(F.max(F.when(F.col("added"), F.col("end"))).over(before) >= F.col("end"), F.lit(False)))
    span = F.struct("start", "place", "end")
    kept = {"live": F.col("is_live") & (is_base | F.col("added")), "copied": is_base & F.col("is_copied"), "further": F.col("added")}
    known = known.groupBy("row").agg(*(F.array_sort(F.collect_list(F.when(v, span))).alias(k) for k, v in kept.items()))
    plain = F.transform(base, lambda s: F.struct(s["start"], s["place"], s["end"])).cast(_SPANS)
    out = found.select("row", "doc_id", *KINDS[:3], plain.alias("base")).join(known, "row", "left")
    out = out.withColumns({"base": F.array_sort("base"), **{k: F.coalesce(k, F.array().cast(_SPANS)) for k in kept}})
    return out.select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "further"))).alias("spans"), _joined(F.col("live")).alias("live"), _joined(F.col("copied")).alias("copied"),
    )
