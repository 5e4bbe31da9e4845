"""A repository of market tables: one versioned Parquet table for each kind of data.

Rows are dealt to hash buckets of the symbol. A save writes the buckets of its
symbols anew into a folder of their own, and then a manifest that says which folder
holds which bucket; the manifest with the largest number is the table. Files that a
manifest names never change, so a reader sees one version whole, a driver that is
lost before its manifest leaves the version before, and of two writers that start
from one version the later one fails. Scans prune by symbol through the bucket and by
date through file statistics; :meth:`Repository.vacuum` deletes what no manifest needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .validation import REQUIRED, diff_summary, hfq_violations, merge, missing_dates, validate

KINDS = ("ohlcv", "adjustment", "financial", "market_value")


@dataclass
class Repository:
    spark: SparkSession
    root: str
    buckets: int = 64

    def _path(self, kind: str) -> str:
        return f"{self.root.rstrip('/')}/{kind}"

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self, kind: str) -> list[int]:
        """Numbers of the manifests of a kind, oldest first."""
        return [int(n.removesuffix(".json")) for n in self._names(f"{self._path(kind)}/_manifests") if n.endswith(".json")]

    def _manifest(self, kind: str, version: int | None = None) -> dict[str, Any]:
        """version, schema and the folder of each bucket; version 0 of a table that was never written has none."""
        version = max(self.versions(kind), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self._path(kind)}/_manifests/{version:010}.json", wholetext=True).first()[0])

    def _commit(self, kind: str, before: dict[str, Any], schema: T.StructType | None, buckets: dict[str, str]) -> None:
        """Make ``buckets`` the table, if nobody else has since ``before``."""
        version = before["version"] + 1
        text = json.dumps({"version": version, "schema": schema.jsonValue() if schema else None, "buckets": buckets})
        folder = f"{self._path(kind)}/_manifests"
        fs, draft = self._fs(f"{folder}/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        _, target = self._fs(f"{folder}/{version:010}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"{kind}: another writer has made version {version}; read it and try again")

    def vacuum(self, kind: str, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` manifests, and folders that none of those names; returns how many folders went.

        Not beside a writer: what it has not committed yet is no version's.
        """
        fs, _ = self._fs(self._path(kind))
        old, kept = self.versions(kind)[:-keep], self.versions(kind)[-keep:]
        needed = {f for v in kept for f in self._manifest(kind, v)["buckets"].values()}
        for v in old:
            fs.delete(self._fs(f"{self._path(kind)}/_manifests/{v:010}.json")[1], False)
        gone = [n for n in self._names(self._path(kind)) if n.startswith("data-") and n not in needed]
        for n in gone:
            fs.delete(self._fs(f"{self._path(kind)}/{n}")[1], True)
        return len(gone)

    def exists(self, kind: str, symbol: str | None = None) -> bool:
        if not self._manifest(kind)["buckets"]:
            return False
        return symbol is None or not self.load(kind, symbols=[symbol]).isEmpty()

    def _bucket(self) -> Any:
        return F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int")

    def _date(self, kind: str) -> str:
        return "report_date" if kind == "financial" else "date"

    def load(self, kind: str, symbols: list[str] | None = None, start: Any = None, end: Any = None, version: int | None = None) -> DataFrame:
        """Rows of a kind in an inclusive date range, of the newest version or a given one; of repeated ohlcv dates the last stays."""
        df = self._rows(kind, self._manifest(kind) if version is None else self._manifest(kind, version), symbols)
        date = self._date(kind)
        df = df if start is None else df.where(F.col(date) >= F.lit(start).cast("date"))
        df = df if end is None else df.where(F.col(date) <= F.lit(end).cast("date"))
        if "_seq" in df.columns:
            last = F.row_number().over(Window.partitionBy("symbol", date).orderBy(F.col("_seq").desc()))
            df = df.withColumn("_k", last).where("_k = 1").drop("_k", "_seq") if kind == "ohlcv" else df.drop("_seq")
        return df

    def save(self, kind: str, data: DataFrame, check: bool = True) -> None:
        """Replace the data of all symbols in ``data``; rejects empty and invalid data (financial data isn't validated)."""
        if data.isEmpty():
            raise ValueError(f"{kind}: no rows to save")
        if check and kind in ("ohlcv", "adjustment", "market_value"):
            bad = validate(data, kind).where("n > 0").limit(20).collect()
            if bad:
                raise ValueError(f"{kind}: {[tuple(r) for r in bad]}")
        self._write(kind, data)

    def _buckets_of(self, symbols: list[str]) -> set[str]:
        return {str(r[0]) for r in self.spark.createDataFrame([(s,) for s in symbols], "symbol string").select(self._bucket()).distinct().collect()}

    def _rows(self, kind: str, manifest: dict[str, Any], symbols: list[str] | None = None, buckets: set[str] | None = None) -> DataFrame:
        """A version's rows of some symbols or buckets, as they are stored."""
        if not manifest["buckets"]:
            raise FileNotFoundError(self._path(kind))
        own = buckets if symbols is None else self._buckets_of(symbols)
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self._path(kind)}/{folder}/bucket={b}" for b, folder in sorted(manifest["buckets"].items()) if own is None or b in own]
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df if symbols is None else df.where(F.col("symbol").isin(symbols))

    def _replace(self, kind: str, before: dict[str, Any], data: DataFrame, touched: set[str] | None) -> None:
        """Write ``data`` and commit it as the content of the ``touched`` buckets (None: of all)."""
        folder = f"data-{uuid.uuid4().hex}"
        data.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self._path(kind)}/{folder}")
        new = {n.removeprefix("bucket="): folder for n in self._names(f"{self._path(kind)}/{folder}") if n.startswith("bucket=")}
        rest = {b: f for b, f in before["buckets"].items() if touched is not None and b not in touched}
        self._commit(kind, before, data.schema if rest | new else None, rest | new)

    def _write(self, kind: str, data: DataFrame) -> None:
        """Replace the rows of all symbols in ``data``."""
        before = self._manifest(kind)
        data = data.withColumn("_seq", F.monotonically_increasing_id())
        touched = {str(r[0]) for r in data.select(self._bucket()).distinct().collect()}  # at most ``buckets``
        if before["buckets"]:
            old = self._rows(kind, before, buckets=touched)
            data = old.join(data.select("symbol").distinct(), "symbol", "left_anti").unionByName(data, allowMissingColumns=True)
        self._replace(kind, before, data, touched)

    def save_derived(self, data: DataFrame, feature_type: str) -> None:
        """Merge derived features into what is stored; new rows replace old ones."""
        if not feature_type or "/" in feature_type or "\\" in feature_type:
            raise ValueError("feature_type must be a name without slashes")
        kind = f"derived/{feature_type}"
        if self.exists(kind):
            data = merge(data, self.load(kind).join(data.select("symbol").distinct(), "symbol", "left_semi"))
        self._write(kind, data)

    def load_derived(self, feature_type: str, **scan: Any) -> DataFrame:
        return self.load(f"derived/{feature_type}", **scan)

    def list_derived(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("derived"))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")) if fs.exists(p) else []

    def save_industry(self, data: DataFrame) -> None:
        if missing := [c for c in REQUIRED["industry"] if c not in data.columns]:
            raise ValueError(f"industry: missing columns {missing}")
        self._replace("industry", self._manifest("industry"), data.withColumn("symbol", F.col("symbol").cast("string")), None)

    def load_industry(self, symbols: list[str] | None = None) -> DataFrame:
        return self._rows("industry", self._manifest("industry"), symbols)

    def list_symbols(self, kind: str = "ohlcv") -> list[str]:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
        return [r[0] for r in self.load(kind).select("symbol").distinct().orderBy("symbol").collect()] if self.exists(kind) else []

    def delete(self, symbol: str, kind: str) -> bool:
        if not self.exists(kind, symbol):
            return False
        before, bucket = self._manifest(kind), self._buckets_of([symbol])
        self._replace(kind, before, self._rows(kind, before, buckets=bucket).where(F.col("symbol") != symbol), bucket)
        return True

    def metadata(self, kind: str) -> DataFrame:
        """symbol, data_type, start_date, end_date and rows."""
        d = self._date(kind)
        span = self.load(kind).groupBy("symbol").agg(F.min(d).cast("string").alias("start_date"), F.max(d).cast("string").alias("end_date"), F.count("*").cast("int").alias("rows"))
        return span.select("symbol", F.lit(kind).alias("data_type"), "start_date", "end_date", "rows", F.lit(True).alias("available"))

    def write_metadata(self, kind: str) -> None:
        """One JSON row for each symbol beside the table."""
        stamped = self.metadata(kind).withColumn("updated_at", F.current_timestamp().cast("string"))
        stamped.coalesce(1).write.mode("overwrite").json(f"{self._path(kind)}_metadata")

    def fetch_start(self, kind: str, requested: Any) -> Any:
        """Where a fetch must begin: adjustment factors share a base, so theirs goes back to the first stored date."""
        if kind != "adjustment" or not self.exists(kind):
            return requested
        first = self.load(kind).agg(F.min("date")).first()[0]
        return requested if first is None else min(first, requested)

    def update_all(self, fetched: dict[str, DataFrame], calendar: DataFrame | None = None, dry_run: bool = False, skip_on_error: bool = True) -> DataFrame:
        """An update for each kind of data; the audit rows of all, with the error of a kind that failed as a whole."""
        out = None
        for kind, data in fetched.items():
            try:
                audit = self.update(kind, data, calendar, dry_run)
            except Exception as e:
                if not skip_on_error:
                    raise
                audit = self.spark.createDataFrame([(kind, False, str(e)[:500])], "data_type string, success boolean, error string")
            out = audit if out is None else out.unionByName(audit, allowMissingColumns=True)
        if out is None:
            raise ValueError("nothing to update")
        return out

    def load_complete(self, symbols: list[str] | None = None, start: Any = None, end: Any = None, include_derived: bool = False) -> dict[str, Any]:
        """ohlcv and adjustment are required; other kinds are None where absent."""
        out: dict[str, Any] = {k: self.load(k, symbols, start, end) for k in ("ohlcv", "adjustment")}
        out |= {k: self.load(k, symbols, start, end) if self.exists(k) else None for k in ("financial", "market_value")}
        if include_derived:
            out["derived"] = {t: self.load_derived(t, symbols=symbols, start=start, end=end) for t in self.list_derived()}
        return out

    def update(self, kind: str, fetched: DataFrame, calendar: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
        """Validate and merge fetched rows of many symbols at once; returns an audit row for each symbol.

        Good rows and the merged table are written once, as audit, checks and save all read them.
        """
        if kind in ("ohlcv", "adjustment", "market_value"):
            bad = validate(fetched, kind).where("n > 0").select("symbol").distinct()
            good = fetched.join(bad, "symbol", "left_anti")
        else:
            bad, good = fetched.select("symbol").limit(0), fetched
        good = written(good, "good")
        old = self.load(kind).join(good.select("symbol").distinct(), "symbol", "left_semi") if self.exists(kind) else good.limit(0)
        date = self._date(kind)
        keys = ("symbol", date)
        audit = diff_summary(good, old, keys)
        gaps = missing_dates(*(t.select("symbol", F.col(date).alias("date")) for t in (good, old)), calendar)
        audit = audit.join(gaps, "symbol", "left").withColumn("date_continuous", F.coalesce(F.size("missing_dates") == 0, F.lit(True)))
        merged = merge(good, old, keys) if dry_run else written(merge(good, old, keys), "merged")
        if kind == "adjustment":
            broken = hfq_violations(merged).groupBy("symbol").agg(F.array_sort(F.collect_list("date")).alias("hfq_violations"))
            audit = audit.join(broken, "symbol", "left").withColumn("hfq_monotonic", F.col("hfq_violations").isNull())
        audit = audit.withColumn("success", F.lit(True)).unionByName(bad.withColumn("success", F.lit(False)), allowMissingColumns=True)
        audit = audit.withColumn("data_type", F.lit(kind)).withColumn("updated_at", F.current_timestamp())
        audit = written(audit, "audit")  # says what was before the update
        if not dry_run and not good.isEmpty():
            self._write(kind, merged)
        return audit


def audit_text(row: Any) -> str:
    """One line of an audit row."""
    r = row.asDict()
    state = "ok" if r.get("success") else f"failed ({r.get('error') or 'invalid rows'})"
    return f"{r.get('symbol') or '*'} {r['data_type']}: {state}, {r.get('new_rows') or 0} new, {r.get('overlap_rows') or 0} overlapping, {r.get('updated_cells') or 0} cells changed"


def audit_lines(audit: DataFrame) -> DataFrame:
    """symbol, data_type and the line of :func:`audit_text` of every audit row."""
    names = [f.name for f in audit.schema.fields]
    have = lambda c: F.col(c).cast("string") if c in names else F.lit(None).cast("string")
    number = lambda c: F.coalesce(have(c), F.lit("0"))
    state = F.when(have("success") == "true", F.lit("ok")).otherwise(F.concat(F.lit("failed ("), F.coalesce(have("error"), F.lit("invalid rows")), F.lit(")")))
    parts = [F.coalesce(have("symbol"), F.lit("*")), F.lit(" "), F.col("data_type"), F.lit(": "), state, F.lit(", "), number("new_rows"), F.lit(" new, "), number("overlap_rows"), F.lit(" overlapping, "), number("updated_cells"), F.lit(" cells changed")]
    return audit.select(have("symbol").alias("symbol"), "data_type", F.concat(*parts).alias("line"))


_default: dict[str, Repository] = {}


def get_repository(spark: SparkSession, root: str) -> Repository:
    """One repository for each root."""
    return _default.setdefault(root, Repository(spark, root))
