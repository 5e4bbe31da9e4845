"""Tables behind a back-test report, and a plain-text summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backtest import BacktestResult
from .performance import drawdown, histogram, monthly_pivot, rolling_ic


def panels(result: BacktestResult, bins: int = 40) -> dict[str, DataFrame]:
    """The report's six tables, each of at most one row a date."""
    daily = result.daily
    return {
        "nav": drawdown(daily), "monthly": monthly_pivot(daily), "returns": histogram(daily, "net_return", bins), "ic": histogram(daily, "ic", bins),
        "ic_path": rolling_ic(daily), "turnover": daily.where(F.col("turnover") > 1e-6).select("date", "turnover"),
    }


def worst_drawdown(daily: DataFrame) -> DataFrame:
    return drawdown(daily).agg(F.min_by("t_idx", "drawdown").alias("t_idx"), F.min("drawdown").alias("drawdown"))


def text_summary(result: BacktestResult) -> str:
    row = result.metrics.first().asDict()
    return "\n".join(f"{k:>14}  {'-' if v is None else format(v, '.4f')}" for k, v in row.items())


def plot(result: BacktestResult, path: str) -> str:
    """Draw the tables to an image; needs matplotlib."""
    import matplotlib.pyplot as plt

    tables = {k: v.toPandas() for k, v in panels(result).items()}
    fig, axes = plt.subplots(3, 2, figsize=(14, 12))
    nav = tables["nav"].sort_values("t_idx")
    axes[0, 0].plot(nav.t_idx, nav.nav)
    axes[0, 1].fill_between(nav.t_idx, nav.drawdown, 0)
    month = tables["monthly"].sort_values("year").set_index("year")
    axes[1, 0].imshow(month.astype(float), aspect="auto")
    axes[1, 1].bar(tables["returns"].low, tables["returns"].n)
    axes[2, 0].bar(tables["ic"].low, tables["ic"].n)
    axes[2, 1].bar(range(len(tables["turnover"])), tables["turnover"].turnover)
    for ax, title in zip(axes.flat, ("net value", "drawdown", "monthly returns", "daily returns", "IC", "turnover"), strict=True):
        ax.set_title(title)
    fig.savefig(path)
    return path
