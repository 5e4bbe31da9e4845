"""Validation, upsert, repository, loader, providers, importers and streams."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from loomfold.sources import importers, loader, providers, validation
from loomfold.sources.repository import Repository, audit_text, get_repository
from loomfold.sources.synthetic import SyntheticMarket

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def bar(symbol, day, close=10.0, **kw):
    x = {"open": close, "high": close, "low": close, "close": close, "volume": 1.0} | kw
    return (symbol, date(2024, 1, day), *(x[k] for k in ("open", "high", "low", "close", "volume")))


@pytest.fixture()
def bars(spark):
    return spark.createDataFrame([bar("000001", d, 10.0 + d) for d in (2, 3, 4, 5)] + [bar("000002", d, 20.0) for d in (2, 3)], BARS)


def test_validate(spark):
    df = spark.createDataFrame([bar("a", 2, high=9.0), bar("a", 3, volume=-1.0), bar("a", 4, close=None, open=1.0, high=1.0, low=1.0), bar("a", 5), bar("a", 5), bar("b", 2, volume=None)], BARS)
    bad = {(r.symbol, r.rule): r.n for r in validation.validate(df, "ohlcv").where("n > 0").collect()}
    assert bad == {("a", "high_below_low"): 1, ("a", "high_below_open"): 1, ("a", "high_below_close"): 1, ("a", "negative_volume"): 1, ("a", "null_close"): 1, ("a", "duplicate"): 2}
    assert validation.check_duplicates(df).count() == 2
    with pytest.raises(ValueError):
        validation.validate(df.drop("close"), "ohlcv")
    with pytest.raises(ValueError):
        validation.validate(df.withColumn("close", F.lit("x")), "ohlcv")


def test_merge_and_diff(spark, bars):
    new = spark.createDataFrame([bar("000001", 5, 15.0 + 1e-9), bar("000001", 8, 1.0), bar("000002", 3, None)], BARS)
    merged = {(r.symbol, r.date.day): r.close for r in validation.merge(new, bars).collect()}
    assert merged[("000002", 3)] is None and merged[("000001", 8)] == 1.0 and len(merged) == 7
    diff = {r.symbol: r for r in validation.diff_summary(new, bars).collect()}
    assert (diff["000001"].new_rows, diff["000001"].overlap_rows, diff["000001"].kept_rows, diff["000001"].updated_cells) == (1, 1, 3, 0)
    assert diff["000002"].updated_cells == 4 and [d.day for d in diff["000002"].changed_dates] == [3]
    filled = {(r.symbol, r.date.day): r.close for r in validation.merge_fill(new, bars).collect()}
    assert filled[("000002", 3)] == 20.0 and len(filled) == 7
    gap = {r.symbol: [d.day for d in r.missing_dates] for r in validation.missing_dates(spark.createDataFrame([bar("000001", 10)], BARS), bars).collect()}
    assert gap == {"000001": [8, 9]}


def test_repository(spark, bars, tmp_path):
    r = get_repository(spark, f"file://{tmp_path}/store")
    assert r is get_repository(spark, f"file://{tmp_path}/store") and not r.exists("ohlcv") and r.list_symbols() == []
    r.save("ohlcv", bars)
    assert r.list_symbols() == ["000001", "000002"] and r.load("ohlcv", ["000001"], "2024-01-03", "2024-01-04").count() == 2
    r.save("ohlcv", bars.where("symbol = '000002'").limit(1))
    assert r.load("ohlcv").count() == 5
    with pytest.raises(ValueError):
        r.save("ohlcv", bars.limit(0))
    with pytest.raises(ValueError):
        r.save("ohlcv", bars.withColumn("volume", F.lit(-1.0)))
    with pytest.raises(ValueError):
        r.list_symbols("other")
    with pytest.raises(ValueError):
        r.save_derived(bars, "a/b")
    r.save_derived(bars.select("symbol", "date", F.lit(1.0).alias("x")), "alpha")
    r.save_derived(bars.limit(1).select("symbol", "date", F.lit(2.0).alias("x")), "alpha")
    assert r.list_derived() == ["alpha"] and sorted(x.x for x in r.load_derived("alpha").collect()) == [1.0] * 5 + [2.0]
    audit = {x.symbol: x for x in r.update("ohlcv", spark.createDataFrame([bar("000001", 8), bar("000003", 8, volume=-1.0)], BARS)).collect()}
    assert audit["000001"].success and audit["000001"].new_rows == 1 and not audit["000003"].success and r.load("ohlcv", ["000001"]).count() == 5
    assert r.delete("000002", "ohlcv") and not r.delete("000002", "ohlcv") and r.metadata("ohlcv").first().rows == 5
    with pytest.raises(FileNotFoundError):
        r.load_complete()
    r.save_industry(spark.createDataFrame([("000001", "x", "y", "z")], "symbol string, sw1_name string, sw2_name string, sw3_name string"))
    assert r.load_industry(["000001"]).count() == 1


def test_loader(spark):
    rows = [bar("a", d, 10.0 * (1 if d < 5 else 2)) for d in (2, 3, 5, 8)] + [bar("b", d, 5.0) for d in (2, 3, 4, 5, 8)] + [bar("c", 4)]
    factors = spark.createDataFrame([("a", date(2024, 1, 3), 2.0), ("a", date(2024, 1, 6), 99.0), ("a", date(2024, 1, 8), 4.0)], "symbol string, date date, hfq_factor double")
    out = loader.load(spark.createDataFrame(rows, BARS), factors, min_trading_days=3)
    got = {(r.symbol, r.t_idx): r for r in out.panel.df.collect()}
    assert [got[("a", t)].hfq_factor for t in range(5)] == [2, 2, 2, 2, 4]
    assert [got[("a", t)].close for t in range(5)] == [20, 20, 20, 40, 80]
    assert got[("a", 2)].is_suspended and not got[("a", 3)].is_limit and got[("a", 4)].is_limit
    assert [r.symbol for r in out.missing_symbols.collect()] == ["c"] and got[("a", 0)].industry == "Unknown"
    qfq = loader.load(spark.createDataFrame(rows, BARS), factors, adj_type="qfq", min_trading_days=3).panel.df.where("symbol = 'a'").orderBy("t_idx").collect()
    assert [r.close for r in qfq] == [5, 5, 5, 10, 20]
    with pytest.raises(ValueError):
        loader.load(spark.createDataFrame(rows, BARS), start="2030-01-01")
    assert out.summary().first().n_symbols == 2


def test_providers(spark):
    s = spark.createDataFrame([("600000",), ("000001",), ("300001",), ("x.y",), ("9",)], "s string")
    assert [r[0] for r in s.select(providers.vendor_symbol(F.col("s"))).collect()] == ["600000.SS", "000001.SZ", "300001.SZ", "x.y", "9.SS"]
    close = lambda *v: spark.createDataFrame([("a", date(2024, 1, 2 + i), float(x)) for i, x in enumerate(v)], "symbol string, date date, close double")
    ex = spark.createDataFrame([("a", date(2024, 1, 3))], "symbol string, date date")
    f = providers.adjustment_factors(close(10, 5, 5, -1), close(5, 5, 5.1, 5), close(20, 20, 21, 20), ex).orderBy("date").collect()
    assert [r.hfq_factor for r in f] == pytest.approx([2, 4, 4]) and [r.qfq_factor for r in f] == pytest.approx([0.5, 1, 1])
    income = spark.createDataFrame([("a", "20231231", 2e8, 1e8, None, 3e7), ("a", "bad", 1.0, 1.0, 1.0, 1.0)], "symbol string, `报告日` string, `营业收入` double, `营业成本` double, `归属于母公司所有者的净利润` double, `净利润` double")
    balance = spark.createDataFrame([("a", "20231231", 9e8, 6e8)], "symbol string, `报告日` string, `资产总计` double, `股东权益合计` double")
    cash = spark.createDataFrame([("a", "20230930", 1e8)], "symbol string, `报告日` string, `经营活动产生的现金流量净额` double")
    row = providers.financial_indicators(income, balance, cash).collect()
    assert len(row) == 1 and row[0].roe == pytest.approx(5) and row[0].gross_profit_margin == pytest.approx(50) and row[0].operating_cash_flow is None
    kline = spark.createDataFrame([("a", "2024-01-02", "1", "2", "x", "1.5", "9")], "symbol string, `日期` string, `开盘` string, `最高` string, `最低` string, `收盘` string, `成交量` string")
    got = providers.clean_kline(kline, "2024-01-01", "2024-01-31").first()
    assert got.low is None and got.close == 1.5
    with pytest.raises(ValueError):
        providers.clean_kline(kline, "2024-02-01", "2024-01-31")
    values = providers.market_values(close(10, 20), spark.createDataFrame([("a", 1e8, 5e7)], "symbol string, total_shares double, circulating_shares double"), spark.createDataFrame([("a", 99.0, 98.0)], "symbol string, total_market_cap double, circulating_market_cap double"), datetime(2024, 1, 3, 16), date(2024, 1, 3))
    assert sorted(r.total_market_cap for r in values.collect()) == [10, 99]
    assert providers.select_mode(2, 1, True) == "update" and providers.select_mode(1, 2, True) == "download" and providers.select_mode(2, 2, False) == "download"


def test_importers(spark):
    assert importers.canonical_name("('000001 CH EQUITY', 'PX_LAST')") == "close" and importers.canonical_name("Date") == "date" and importers.canonical_name("FOO") == "foo"
    raw = spark.createDataFrame([("a", "2024-01-02", "1", "1", "1", "1", None, "7"), ("a", "2024-01-03", "1", "1", "1", "bad", "5", None)], "symbol string, date string, open string, high string, low string, close string, volume string, pe string")
    assert importers.build_ohlcv(raw).count() == 1 and importers.build_market_value(raw).count() == 1 and importers.build_supplement(raw).count() == 1
    members = spark.createDataFrame([("1", "n", "c1", 2), ("1", "n", "c2", 1)], "symbol string, name string, sw3_code string, place int")
    out = importers.industry_hierarchy(members, spark.createDataFrame([("c2", "t", "s")], "sw3_code string, sw3_name string, sw2_name string"), spark.createDataFrame([("s", "f")], "sw2_name string, sw1_name string")).collect()
    assert len(out) == 1 and out[0].symbol == "000001" and out[0].sw1_name == "f"


def test_synthetic_market(spark):
    df = SyntheticMarket(n_stocks=10, n_days=30, n_industries=3).generate(spark).df.toPandas()
    assert len(df) == 300 and (df.high >= df[["open", "close"]].max(axis=1)).sum() == df.close.notna().sum() and df.is_suspended.sum() == df.close.isna().sum() > 0
    assert df.groupby("industry").symbol.nunique().min() >= 2
    with pytest.raises(ValueError):
        SyntheticMarket(n_stocks=3, n_industries=3)


def test_repository_survives_a_dry_run(spark, bars, tmp_path):
    r = Repository(spark, f"file://{tmp_path}/dry")
    r.update("ohlcv", bars, dry_run=True)
    assert not r.exists("ohlcv")


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    q, o = entry_points.queries(), entry_points.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70


@pytest.mark.parametrize("name", ["stream_upsert", "tuner_grid", "upsert_diff"])
def test_query_runs(spark, sf_dir, name):
    assert entry_points.queries()[name](spark, sf_dir).count() > 0


def test_update_all_and_panels(spark, bars, tmp_path):
    r = Repository(spark, f"file://{tmp_path}/all")
    broken = spark.createDataFrame([("x",)], "symbol string")
    rows = r.update_all({"ohlcv": bars, "adjustment": broken}).collect()
    assert {(x.data_type, x.success) for x in rows} == {("ohlcv", True), ("adjustment", False)} and all(audit_text(x) for x in rows)
    with pytest.raises(ValueError):
        r.update_all({"adjustment": broken}, skip_on_error=False)
    r.write_metadata("ohlcv")
    assert spark.read.json(f"file://{tmp_path}/all/ohlcv_metadata").count() == 2
    factors = spark.createDataFrame([("000001", date(2024, 1, 2), 1.0, 1.0)], "symbol string, date date, qfq_factor double, hfq_factor double")
    r.save("adjustment", factors)
    assert r.fetch_start("adjustment", date(2024, 2, 1)) == date(2024, 1, 2) and r.fetch_start("ohlcv", 5) == 5
    grid = loader.field_panel(bars, ["close"])
    assert grid.count() == 8 and loader.matrix(grid, "close").columns == ["date", "000001", "000002"]


def test_a_version_is_whole_or_not_there(spark, bars, tmp_path, monkeypatch):
    r = Repository(spark, f"file://{tmp_path}/versions", buckets=3)
    r.save("ohlcv", bars)
    before = sorted(map(tuple, r.load("ohlcv").collect()))
    raised = bars.withColumns({c: F.col(c) + 5 for c in ("open", "high", "low", "close")})

    def lost(*a):
        raise KeyboardInterrupt("the driver is gone")

    with monkeypatch.context() as m:  # files are written, the manifest is not
        m.setattr(Repository, "_commit", lost)
        for change in (lambda: r.save("ohlcv", raised), lambda: r.update("ohlcv", raised), lambda: r.delete("000001", "ohlcv")):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert r.versions("ohlcv") == [1] and sorted(map(tuple, r.load("ohlcv").collect())) == before
    stale = r._manifest("ohlcv")
    reading = r.load("ohlcv")  # a reader of version 1
    r.save("ohlcv", raised)
    assert sorted(map(tuple, reading.collect())) == before == sorted(map(tuple, r.load("ohlcv", version=1).collect()))
    assert sorted(x.close for x in r.load("ohlcv").collect()) == [17.0, 18.0, 19.0, 20.0, 25.0, 25.0]
    with pytest.raises(RuntimeError, match="another writer"):
        r._commit("ohlcv", stale, None, {})
    r.save("ohlcv", bars.withColumn("extra", F.lit(1.5)).where("symbol = '000002'"))
    assert {(x.symbol, x.extra) for x in r.load("ohlcv").select("symbol", "extra").distinct().collect()} == {("000001", None), ("000002", 1.5)}
    assert r.versions("ohlcv") == [1, 2, 3] and r.vacuum("ohlcv", keep=1) > 0 and r.versions("ohlcv") == [3]
    assert r.load("ohlcv").count() == len(before) and r.vacuum("ohlcv") == 0
    assert r.delete("000001", "ohlcv") and r.delete("000002", "ohlcv") and not r.exists("ohlcv")
    with pytest.raises(FileNotFoundError):
        r.load("ohlcv")
    r.save("ohlcv", bars)
    assert sorted(map(tuple, r.load("ohlcv").collect())) == before


def test_import_of_files_reports_each(spark, tmp_path):
    good = "date,PX_OPEN,PX_HIGH,PX_LOW,PX_LAST,VOLUME,PE_RATIO\n2024-01-02,1,2,1,1.5,10,7\n2024-01-03,1,2,1,,10,\n2024-01-04,1,2,1,1.6,x,8\n"
    for name, text in {"000001": good, "000002": "date,PX_LAST\n2024-01-02,1\n", "000003": "\n", "000004": good.replace("1.5", "?").replace("1.6", "--"), "000005": good.replace("\n", "\r\n").replace("2024-01-04", "04/01/24")}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows, status = importers.import_files(spark, f"file://{tmp_path}/*.csv")
    got = {r.symbol: (r.success, r.rows, r.pe_rows, r.error) for r in status.collect()}
    assert got == {
        "000001": (True, 2, 2, None), "000002": (False, 0, 0, "missing columns: open, high, low, volume"), "000003": (False, 0, 0, "no header"), "000004": (False, 0, 2, "no rows with a close"),
        "000005": (True, 1, 1, None),
    }
    assert sorted((r.symbol, str(r.date), r.close, r.volume, r.pe) for r in rows.collect()) == [("000001", "2024-01-02", 1.5, 10.0, 7.0), ("000001", "2024-01-04", 1.6, None, 8.0), ("000005", "2024-01-02", 1.5, 10.0, 7.0)]


def test_bundle_keeps_going_when_a_fetch_fails(spark, bars):
    def broken():
        raise OSError("no line")

    values = bars.where("symbol = '000001'").select("symbol", "date", F.lit(3.0).alias("pe"))
    found, errors = providers.complete_bundle(spark, {"ohlcv": lambda: bars, "market_value": lambda: values, "financial": broken, "adjustment": broken})
    assert set(found) == {"ohlcv", "market_value", "financial", "adjustment", "aligned_daily"} and errors == {"financial": "no line", "adjustment": "no line"}
    assert found["financial"].count() == 0 and "report_date" in found["financial"].columns and found["aligned_daily"].where("pe is not null").count() == 4
    found, errors = providers.complete_bundle(spark, {"ohlcv": broken, "market_value": broken})
    assert found["aligned_daily"].count() == 0 and {"close", "pe"} <= set(found["aligned_daily"].columns) and set(errors) == {"ohlcv", "market_value"}
