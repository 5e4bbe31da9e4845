"""Grid search of factor and back-test parameters."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from .backtest import VectorEngine
from .expr import Expr, col
from .grid import metrics, signal_of
from .panel import Panel

BACKTEST_KEYS = ("rebalance_freq", "top_n", "weight_method", "cost_rate", "delay", "decay", "start_date", "end_date")
METRICS = ("ann_return", "ann_vol", "sharpe", "calmar", "max_drawdown", "ic_mean", "icir", "ic_win_rate", "avg_turnover", "fitness")


def combo_id(factor: dict[str, Any], backtest: dict[str, Any]) -> str:
    return "|".join(f"{k}={v}" for part in (factor, backtest) for k, v in part.items()) or "default"


def build_combos(factor_params: dict[str, list], backtest_params: dict[str, list]) -> list[dict[str, Any]]:
    """The cartesian product, keys sorted, factor keys first; empty spaces give one default."""
    f_keys, b_keys = sorted(factor_params), sorted(backtest_params)
    out = []
    for values in itertools.product(*(factor_params[k] for k in f_keys), *(backtest_params[k] for k in b_keys)):
        f, b = dict(zip(f_keys, values, strict=False)), dict(zip(b_keys, values[len(f_keys) :], strict=False))
        out.append({"id": combo_id(f, b), "factor_params": f, "backtest_params": b})
    return out


class ParameterTuner:
    """Back-tests every combination of ``factor_fn(close, volume, high, low, **params)`` and ranks them.

    All combinations of one date range are one plan over one scan of the panel
    (:mod:`.grid`). A combination that fails has null metrics: those that cannot be
    built or analysed leave the plan; if a plan fails when it runs, its combinations
    run one by one, ``n_jobs`` at a time. If all fail, run raises. Targets are compared
    rounded to ``decimals`` places, so that combinations that hold the same names tie however
    their returns were summed; ties stand in the combinations' order.
    """

    def __init__(
        self, factor_fn: Callable[..., Expr], panel: Panel, factor_params: dict[str, list] | None = None, backtest_params: dict[str, list] | None = None,
        opt_target: str | dict[str, str] = "sharpe", industry: bool = False, n_jobs: int = 1, decimals: int = 9,
    ):
        if not callable(factor_fn):
            raise TypeError("factor_fn must be callable")
        factor_params, backtest_params = factor_params or {}, backtest_params or {}
        for name, space in (("factor_params", factor_params), ("backtest_params", backtest_params)):
            if any(not isinstance(v, (list, tuple)) or not len(v) for v in space.values()):
                raise ValueError(f"{name} must map names to non-empty lists")
        if unknown := set(backtest_params) - set(BACKTEST_KEYS):
            raise ValueError(f"unknown back-test parameters: {sorted(unknown)}")
        targets = {opt_target: "desc"} if isinstance(opt_target, str) else dict(opt_target)
        if not targets or set(targets) - set(METRICS) or set(targets.values()) - {"asc", "desc"}:
            raise ValueError("opt_target must map metrics to 'asc' or 'desc'")
        if not isinstance(n_jobs, int) or n_jobs < 1:
            raise ValueError("n_jobs must be a positive integer")
        self.factor_fn, self.panel, self.targets, self.industry, self.n_jobs, self.decimals = factor_fn, panel, targets, industry, n_jobs, decimals
        self.combos = build_combos(factor_params, backtest_params)
        self._results: pd.DataFrame | None = None

    def _engine(self, combo: dict[str, Any]) -> VectorEngine:
        factor = self.factor_fn(col("close"), col("volume"), col("high"), col("low"), **combo["factor_params"])
        return VectorEngine(factor, self.panel, industry=self.industry, **combo["backtest_params"])

    def _row(self, combo: dict[str, Any]) -> dict[str, Any]:
        return {"combo_id": combo["id"], **{f"f_{k}": v for k, v in combo["factor_params"].items()}, **{f"b_{k}": v for k, v in combo["backtest_params"].items()}}

    def _prepared(self, combo: dict[str, Any]) -> VectorEngine | str:
        """The combination's engine, or what is wrong with it."""
        try:
            engine = self._engine(combo)
            if isinstance(engine.factor, Expr):
                engine.panel.with_factors(_probe=signal_of(engine.factor, engine))  # analyses, runs nothing
            return engine
        except Exception as e:  # a user's factor may fail for some parameters
            return str(e)[:500]

    def _alone(self, engine: VectorEngine) -> dict[str, Any]:
        try:
            return engine.run().metrics.select(*METRICS).first().asDict() | {"error": None}
        except Exception as e:
            return {**dict.fromkeys(METRICS), "error": str(e)[:500]}

    def _together(self, engines: dict[int, VectorEngine]) -> dict[int, dict[str, Any]]:
        """Metrics of engines of one date range."""
        try:
            return {n: {k: found[k] for k in METRICS} | {"error": None} for n, found in metrics(engines).items()}
        except Exception:  # which of them it was shows when each runs alone
            with ThreadPoolExecutor(self.n_jobs) as pool:
                return dict(zip(engines, pool.map(self._alone, engines.values()), strict=True))

    def run(self) -> pd.DataFrame:
        prepared = [self._prepared(c) for c in self.combos]
        found = {n: {**dict.fromkeys(METRICS), "error": e} for n, e in enumerate(prepared) if isinstance(e, str)}
        ranges: dict[tuple, dict[int, VectorEngine]] = {}
        for n, engine in enumerate(prepared):
            if n not in found and isinstance(engine.factor, Expr):
                ranges.setdefault((str(engine.start_date), str(engine.end_date)), {})[n] = engine
            elif n not in found:
                found[n] = self._alone(engine)  # a table of values is aligned to its own dates
        for engines in ranges.values():
            found |= self._together(engines)
        rows = [self._row(c) | found[n] for n, c in enumerate(self.combos)]
        if all(r["error"] is not None for r in rows):
            raise RuntimeError(f"all combinations failed, the first with: {rows[0]['error']}")
        table = pd.DataFrame(rows)
        compared = table[list(self.targets)].astype(float).round(self.decimals)
        compared["_place"] = range(len(table))  # a sort by several columns is not stable
        order = compared.sort_values(list(compared), ascending=[*(d == "asc" for d in self.targets.values()), True], na_position="last").index
        table = table.loc[order]
        table.insert(0, "rank", range(1, len(table) + 1))
        self._results = table.reset_index(drop=True)
        return self._results

    @property
    def results_df(self) -> pd.DataFrame:
        if self._results is None:
            raise RuntimeError("call run() first")
        return self._results

    def top(self, n: int = 10) -> pd.DataFrame:
        return self.results_df.head(n)

    def get_result(self, rank: int = 1) -> dict[str, Any]:
        if not 1 <= rank <= len(self.results_df):
            raise IndexError(f"rank {rank} is outside 1 to {len(self.results_df)}")
        return self.results_df.iloc[rank - 1].to_dict()

    def get_result_by_id(self, combo: str) -> dict[str, Any]:
        found = self.results_df[self.results_df.combo_id == combo]
        if not len(found):
            raise KeyError(combo)
        return found.iloc[0].to_dict()

    def backtest(self, rank: int = 1):
        """The full back-test of a ranked combination."""
        own = self.get_result(rank)["combo_id"]
        return self._engine(next(c for c in self.combos if c["id"] == own)).run()

    def summary(self) -> str:
        best = self.get_result(1)
        return f"{len(self.combos)} combinations, {int(self.results_df.error.notna().sum())} failed; best: {best['combo_id']}"

    def results(self) -> DataFrame:
        """The ranked table as a DataFrame of the session."""
        return self.panel.df.sparkSession.createDataFrame(self.results_df.drop(columns="error"))
