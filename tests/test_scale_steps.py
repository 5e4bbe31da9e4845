"""Steps that larger tables made too slow: what is read many times is computed once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomfold import store_queries
from loomfold.operators import ops
from loomfold.plans import grid, performance, tuning
from loomfold.plans.backtest import VectorEngine
from loomfold.plans.expr import col, compile_exprs
from loomfold.sources import importers
from loomfold.sources.bars import supplier_panel
from loomfold.sources.repository import Repository
from loomfold.sources.shared import fresh_folder, write_files


def test_bars_of_store_queries_are_made_once(spark, sf_dir):
    bars = store_queries._bars(spark, sf_dir)
    assert bars.inputFiles() and not any("lineitem" in f for f in bars.inputFiles())


def test_an_update_reads_what_is_fetched_few_times(spark):
    rows = spark.createDataFrame([("1", "2024-01-02"), ("1", "2024-01-03"), ("2", "2024-01-03")], "symbol string, date string")
    bars = rows.select("symbol", F.col("date").cast("date").alias("date"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")))
    repository = Repository(spark, fresh_folder(spark, "repository"), buckets=2)
    repository.save("ohlcv", bars.where("symbol = '1'"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        reads.add(1)
        yield from batches

    fetched = bars.coalesce(1).mapInArrow(count, bars.schema)
    audit = {r.symbol: (r.new_rows, r.overlap_rows) for r in repository.update("ohlcv", fetched).collect()}
    assert audit == {"1": (0, 2), "2": (1, 0)} and repository.load("ohlcv").count() == 3
    assert reads.value <= 3  # to validate, and to write what is not bad


def test_tuner_ranks_equal_holdings_in_the_combinations_order(spark, sf_dir, monkeypatch):
    found = iter([1.0, 1.0 + 4e-16, 2.0, None, 1.0 - 2e-16])
    monkeypatch.setattr(tuning, "metrics", lambda engines: {n: dict.fromkeys(tuning.METRICS) | {"sharpe": next(found)} for n in engines})
    tuner = tuning.ParameterTuner(lambda close, volume, high, low, days: ops.Ts_Delta(close, days), supplier_panel(spark, sf_dir), {"days": [1, 2, 3, 4, 5]})
    assert tuner.run().f_days.tolist() == [3, 1, 2, 5, 4]


def sorts_a_task(df):
    """The most sorts between two exchanges of a plan that is one chain."""
    return max(part.count("Sort [") for part in df._jdf.queryExecution().executedPlan().toString().split("Exchange "))


def test_a_rank_sorts_once_and_many_correlations_no_more_than_two(spark):
    names = [f"f{i}" for i in range(12)]
    panel = spark.range(60).select((F.col("id") % 3).cast("int").alias("t_idx"), F.col("id").alias("symbol"), (F.col("id") % 7).cast("double").alias("ret"), *((F.col("id") * (i + 5) % 11).cast("double").alias(n) for i, n in enumerate(names)))
    assert sorts_a_task(compile_exprs(panel, {"r": ops.Rank(col("f0"))})) == 1
    assert sorts_a_task(performance.ic_rows(panel, names, "ret")) == sorts_a_task(performance.ic_rows(panel, names[:2], "ret")) <= 2


def test_correlations_with_ties_nulls_and_constant_dates(spark):
    nan = float("nan")
    y, a, b = [3.0, 1.0, 1.0, 2.0, nan, 5.0, 5.0], [1.0, 1.0, nan, 2.0, 4.0, 0.0, 2.0], [2.0] * 7
    null = lambda v: None if v != v else v
    rows = [(t, s, null(y[s]), null(a[s]) if t == 0 else None, b[s]) for t in range(2) for s in range(7)]
    panel = spark.createDataFrame(rows, "t_idx int, symbol int, y double, a double, b double").repartition(3)
    got = {(r.t_idx, r.i): r.ic for r in performance.ic_rows(panel, ["a", "b"], "y").collect()}
    ranks = pd.DataFrame({"y": y, "a": a}).rank(pct=True)
    own = ranks - ranks.mean()
    want = (own.y * own.a).sum() / ((own.y**2).sum() ** 0.5 * (own.a**2).sum() ** 0.5)
    assert got == {(0, 0): pytest.approx(want), (0, 1): None, (1, 0): None, (1, 1): None}


def test_one_task_holds_a_small_part_of_the_dates_and_symbols_of_a_grid(spark, sf_dir):
    engines = {n: VectorEngine(ops.Rank(ops.Ts_Delta(col("close"), n + 1)), supplier_panel(spark, sf_dir), top_n=2) for n in range(4)}
    wide, runs = grid.signals(engines)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {grid.TASKS}), REPARTITION_BY_NUM") == 2
    assert len({r.signal for r in runs}) == 4


def test_files_are_written_by_name_and_read_once_for_their_status(spark, tmp_path):
    good = "date,open,high,low,close,volume\n2024-01-02,1,2,1,1.5,10\n2024-01-03,1,2,1,ü,10\n"
    texts = spark.createDataFrame([("000001.csv", good), ("ü 2%.csv", "date"), ("000003.csv", ""), *((f"{i}.csv", good) for i in range(10, 60))], "name string, value string")
    for folder in (f"file://{tmp_path}/uri%20a", f"{tmp_path}/plain"):
        for _ in range(2):  # as when a task is repeated
            write_files(texts.repartition(3), folder)
    assert (tmp_path / "uri a").is_dir() and sorted(p.name for p in (tmp_path / "plain").rglob("*.csv")) == sorted(r.name for r in texts.collect())
    rows, status = importers.import_files(spark, f"{tmp_path}/plain")
    assert status._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.symbol: tuple(r)[1:] for r in status.collect()}
    assert len(got) == 53 and got["000001"] == got["59"] == (True, 1, 0, None) and got["000003"][3] == "no header" and sum(str(x[3]).startswith("missing columns: open") for x in got.values()) == 1
    assert rows.count() == 51


def test_files_of_one_symbol_have_a_status_each(spark):
    head = "date,open,high,low,close,volume\n"
    files = spark.createDataFrame([("1", head + "2024-01-02,1,2,1,1.5,10"), ("1", head + "2024-01-03,1,2,1,1.5,10\n2024-01-04,1,2,1,1.5,10"), ("1", None)], "symbol string, value string")
    assert sorted((r.rows, r.success) for r in importers.import_texts(files)[1].collect()) == [(0, False), (1, True), (2, True)]
