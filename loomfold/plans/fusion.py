"""Labels, statistical and expanding-window model combinations of factors."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ops
from ..sources.shared import written
from .backtest import BacktestResult, VectorEngine
from .expr import EPS, Expr, as_expr, cell, col, compile_exprs
from .forest import LEAST_ROWS, Forest, grow, predict
from .panel import Panel, broadcast_if_small, intersected

TARGETS, METHODS = ("close", "open", "vwap"), ("return", "log_return")


class Labeler:
    """Forward returns as expressions over a panel."""

    @staticmethod
    def set_label(target: str = "close", horizon: int = 1, method: str = "return", custom_label: Expr | None = None, panel: Panel | None = None) -> Expr:
        """A custom label as it is, or the ``horizon``-row forward return of a price; null where a price is missing or 0."""
        if custom_label is not None:
            if not isinstance(custom_label, Expr):
                raise TypeError("custom_label must be an expression")
            return custom_label
        if target not in TARGETS:
            raise ValueError(f"target must be one of {TARGETS}, not {target!r}")
        if panel is not None and target not in panel.df.columns:
            raise ValueError(f"the panel has no column {target!r}")
        return Labeler.from_price(col(target), horizon, method)

    @staticmethod
    def from_price(price: Expr, horizon: int = 1, method: str = "return") -> Expr:
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {method!r}")
        if not isinstance(horizon, int) or isinstance(horizon, bool) or horizon < 1:
            raise ValueError("horizon must be a positive integer")
        ratio = ops.Ts_Delay(price, -horizon) / price
        return ratio - 1 if method == "return" else cell("ln", lambda r: F.when(r > 0, F.ln(r)), ratio)


def min_variance_weights(cov: np.ndarray) -> np.ndarray:
    """Weights of least variance that sum to 1 and lie in [0, 1], by an active set."""
    k = len(cov)
    active = np.ones(k, bool)
    for _ in range(4 * k + 4):
        own = cov[np.ix_(active, active)] + 1e-14 * np.eye(active.sum())
        w = np.zeros(k)
        part = np.linalg.solve(own, np.ones(active.sum()))
        w[active] = part / part.sum()
        if (w < -1e-12).any():
            active[np.argmin(w)] = False
            continue
        slope = cov @ w
        free = ~active & (slope < slope[active].min() - 1e-12)
        if not free.any():
            break
        active[np.argmin(np.where(free, slope, np.inf))] = True
    w = np.clip(w, 0, 1)
    return w / w.sum()


def from_tables(factors: Sequence[DataFrame], label: DataFrame | None = None) -> tuple[Panel, list[Expr], Expr | None]:
    """Panel, factors and label to fit or predict on, from tables (date, symbol, value): the grid is what they have in common."""
    names = [f"f{i}" for i in range(len(factors))]
    panel = Panel(intersected(dict(zip(names, factors, strict=True)) | ({} if label is None else {"y": label})))
    return panel, [col(n) for n in names], None if label is None else col("y")


class FactorCombiner(ABC):
    """Fits on a panel's factors and a label, predicts one value for each cell.

    Factors and label are expressions over the panel, or tables (date, symbol,
    value) of any grids, see :meth:`fit_tables`.
    """

    factors: tuple[Expr, ...] = ()

    @abstractmethod
    def fit(self, panel: Panel, factors: Sequence[Any], label: Expr) -> FactorCombiner: ...

    @abstractmethod
    def predict(self, panel: Panel, factors: Sequence[Any] | None = None) -> DataFrame: ...

    def fit_tables(self, factors: Sequence[DataFrame], label: DataFrame) -> FactorCombiner:
        """Fit on the dates and symbols that all the tables have."""
        return self.fit(*from_tables(factors, label))

    def predict_tables(self, factors: Sequence[DataFrame]) -> DataFrame:
        """Predictions for the dates and symbols that all the tables have."""
        panel, own, _ = from_tables(factors)
        return self.predict(panel, own)

    def _ranked(self, panel: Panel, factors: Sequence[Any], **more: Expr) -> DataFrame:
        """The panel's keys with ranks x0 … of the factors and further columns."""
        columns = {f"x{i}": ops.Rank(as_expr(f)) for i, f in enumerate(factors)}
        return compile_exprs(panel.df, columns | more).select("date", "t_idx", "symbol", "symbol_pos", *columns, *more)

    def _given(self, factors: Sequence[Any] | None) -> tuple[Expr, ...]:
        own = self.factors if factors is None else tuple(map(as_expr, factors))
        if not self.factors:
            raise RuntimeError("fit the combiner first")
        if len(own) != len(self.factors):
            raise ValueError(f"fitted on {len(self.factors)} factors, given {len(own)}")
        return own

    def evaluate(self, panel: Panel, factors: Sequence[Any] | None = None, delay: int = 0, **engine: Any) -> BacktestResult:
        """Back-test of the predictions; the delay defaults to 0, as they already look back."""
        return VectorEngine(self.predict(panel, factors), panel, delay=delay, **engine).run()


class StatisticalCombiner(FactorCombiner):
    """Equal, IC-weighted or minimum-variance weights of factor ranks."""

    def __init__(self, method: str = "equal"):
        if method not in ("equal", "ic_weighted", "min_variance"):
            raise ValueError(f"unknown method {method!r}")
        self.method, self.weights = method, np.zeros(0)

    def ic_matrix(self, panel: Panel, factors: Sequence[Any], label: Expr) -> DataFrame:
        """(t_idx, ic_0 …): correlations of each factor's ranks with the label's, over pairs."""
        df = self._ranked(panel, factors, y=ops.Rank(label))
        out = []
        for i in range(len(factors)):
            x, y = F.when(F.col("y").isNotNull(), F.col(f"x{i}")), F.when(F.col(f"x{i}").isNotNull(), F.col("y"))
            varied = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
            out.append(F.when(varied, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))).alias(f"ic_{i}"))
        return df.groupBy("t_idx").agg(*out)

    def fit(self, panel: Panel, factors: Sequence[Any], label: Expr | None = None) -> StatisticalCombiner:
        self.factors = tuple(map(as_expr, factors))
        k = len(self.factors)
        if not k:
            raise ValueError("no factors given")
        self.weights = np.full(k, 1 / k)
        if self.method == "ic_weighted":
            if label is None:
                raise ValueError("ic_weighted needs a label")
            row = self.ic_matrix(panel, self.factors, label).agg(*(F.avg(f"ic_{i}") for i in range(k))).first()
            means = np.array([0.0 if v is None else v for v in row])
            if np.abs(means).sum() >= EPS:
                self.weights = means / np.abs(means).sum()
        elif self.method == "min_variance":
            df = self._ranked(panel, self.factors).dropna(subset=[f"x{i}" for i in range(k)])
            pairs = [(i, j) for i in range(k) for j in range(i, k)]
            row = df.agg(F.count("*"), *(F.covar_samp(f"x{i}", f"x{j}") for i, j in pairs)).first()
            if row[0] >= 2 * k:
                cov = np.zeros((k, k))
                for (i, j), v in zip(pairs, row[1:], strict=True):
                    cov[i, j] = cov[j, i] = v or 0.0
                self.weights = min_variance_weights(cov)
        return self

    def predict(self, panel: Panel, factors: Sequence[Any] | None = None) -> DataFrame:
        """Weighted ranks; a missing rank counts 0, all missing gives null."""
        own = self._given(factors)
        df = self._ranked(panel, own)
        names = [f"x{i}" for i in range(len(own))]
        value = sum((F.lit(float(w)) * F.coalesce(F.col(n), F.lit(0.0)) for w, n in zip(self.weights, names, strict=True)), F.lit(0.0))
        return df.select("date", "t_idx", "symbol", "symbol_pos", F.when(F.coalesce(*names).isNotNull(), value).alias("value"))

    def save(self, spark: SparkSession, path: str) -> None:
        _save_json(spark, path, {"kind": "statistical", "method": self.method, "weights": self.weights.tolist()})

    @classmethod
    def load(cls, spark: SparkSession, path: str, factors: Sequence[Any]) -> StatisticalCombiner:
        state = _load_json(spark, path, "statistical")
        out = cls(state["method"])
        out.weights, out.factors = np.array(state["weights"]), tuple(map(as_expr, factors))
        return out


def _save_json(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def _load_json(spark: SparkSession, path: str, kind: str) -> dict:
    state = json.loads(spark.read.text(f"{path}/model").first()[0])
    if state.get("kind") != kind:
        raise TypeError(f"{path} holds no {kind} combiner")
    return state


MODELS = ("linear", "ridge", "random_forest", "xgboost")


class MLCombiner(FactorCombiner):
    """Models of factor ranks, refitted on an expanding window.

    A model fitted on rows before ``end`` predicts rows from ``end`` to the
    next refit, on panels with the dates and symbols it was fitted on; the last
    one, of all rows, predicts any other panel. ``purge`` rows before ``end`` can be
    left out, so that labels do not look past it; by default none are.

    ``fit`` writes the ranked panel once, to the session's shared folder, and the
    predictions of it when they are first asked for. ``predict`` returns that table
    for the panel and factors it was fitted on, which it knows by their plans, so
    other values of the same dates and symbols are predicted anew.
    """

    def __init__(
        self, model_type: str = "ridge", min_train_periods: int = 60, refit_freq: int = 20, ridge_alpha: float = 1.0, rf_n_estimators: int = 100,
        rf_max_depth: int = 5, xgb_n_estimators: int = 100, xgb_max_depth: int = 3, xgb_learning_rate: float = 0.1, purge: int = 0,
    ):
        if model_type not in MODELS:
            raise ValueError(f"model_type must be one of {MODELS}, not {model_type!r}")
        if model_type == "xgboost":
            try:
                import xgboost.spark  # noqa: F401
            except ImportError as e:
                raise ImportError("model_type 'xgboost' needs the xgboost package") from e
        self.model_type, self.min_train_periods, self.refit_freq, self.ridge_alpha, self.purge = model_type, min_train_periods, refit_freq, ridge_alpha, purge
        self.rf_n_estimators, self.rf_max_depth = rf_n_estimators, rf_max_depth
        self.boosting = (xgb_n_estimators, xgb_max_depth, xgb_learning_rate)
        self.ends: list[int] = []
        self.blocks: list[dict] = []
        self.importances = np.zeros(0)
        self.forest: Forest | None = None
        self.boosted: list[tuple[int, int, Any]] = []
        self.grid: list[str] = []
        self._fitted: tuple[DataFrame, tuple, DataFrame] | None = None
        self._predictions: DataFrame | None = None

    def _ends(self, periods: int) -> list[int]:
        return [*range(self.min_train_periods, periods, self.refit_freq), periods]

    def fit(self, panel: Panel, factors: Sequence[Any], label: Expr) -> MLCombiner:
        self.factors = tuple(map(as_expr, factors))
        k = len(self.factors)
        if not k:
            raise ValueError("no factors given")
        names = [f"x{i}" for i in range(k)]
        df = written(self._ranked(panel, self.factors, y=label), "ranked")
        self._fitted, self._predictions = (panel.df, tuple(f.key for f in self.factors), df), None
        self.grid = _grid_of(df)
        periods = df.agg(F.max("t_idx")).first()[0]
        ends = self.ends = self._ends(0 if periods is None else periods + 1)
        full = df.dropna(subset=[*names, "y"])
        self.blocks, self.boosted, self.forest = [], [], None
        if self.model_type == "random_forest":
            rows = full.select("t_idx", F.xxhash64("symbol", "t_idx").alias("key"), *names, "y")
            self.forest = grow(rows, k, ends, trees=self.rf_n_estimators, depth=self.rf_max_depth, purge=self.purge)
            mean = self.forest.importances(k)
        elif self.model_type == "xgboost":
            found = []
            for end in ends:
                train = full.where(F.col("t_idx") < end - self.purge)
                if train.count() >= LEAST_ROWS:
                    model = self._boosted_model(train, names)
                    self.boosted.append((end, min(end + self.refit_freq, ends[-1]), model))
                    found.append(np.abs(model.stages[-1].featureImportances.toArray()))
            mean = np.mean(found, axis=0) if found else np.zeros(k)
        else:
            mean = self._fit_linear(full, names, ends)
        self.importances = mean / mean.sum() if mean.sum() > 0 else np.full(k, 1 / k)
        return self

    def _fit_linear(self, full: DataFrame, names: list[str], ends: list[int]) -> np.ndarray:
        """Blocks of coefficients from sufficient statistics, one row for each date; returns their mean size."""
        k = len(names)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        sums = [F.count("*"), F.sum("y"), *(F.sum(n) for n in names), *(F.sum(F.col(n) * F.col("y")) for n in names), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs)]
        daily = np.zeros((ends[-1], len(sums)))
        for r in full.groupBy("t_idx").agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).collect():
            daily[r[0]] = r[1:]
        total = np.concatenate([np.zeros((1, len(sums))), np.cumsum(daily, axis=0)])
        found = []
        for end in ends:
            s = total[max(0, end - self.purge)]
            n = s[0]
            if n < LEAST_ROWS:
                continue
            sy, sx, sxy = s[1], s[2 : 2 + k], s[2 + k : 2 + 2 * k]
            xx = np.zeros((k, k))
            for (i, j), v in zip(pairs, s[2 + 2 * k :], strict=True):
                xx[i, j] = xx[j, i] = v
            gram = xx - np.outer(sx, sx) / n
            right = sxy - sx * sy / n
            w = np.linalg.solve(gram + self.ridge_alpha * np.eye(k), right) if self.model_type == "ridge" else np.linalg.lstsq(gram, right, rcond=None)[0]
            self.blocks.append({"start": end, "stop": min(end + self.refit_freq, ends[-1]), "intercept": float((sy - w @ sx) / n), "coef": w.tolist()})
            found.append(np.abs(w))
        return np.mean(found, axis=0) if found else np.zeros(k)

    def _boosted_model(self, train: DataFrame, names: list[str]) -> Any:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        from xgboost.spark import SparkXGBRegressor

        count, depth, rate = self.boosting
        model = SparkXGBRegressor(label_col="y", features_col="features", n_estimators=count, max_depth=depth, learning_rate=rate)
        return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), model]).fit(train)

    def predict(self, panel: Panel, factors: Sequence[Any] | None = None) -> DataFrame:
        """Predictions from row ``min_train_periods`` on, for cells with all factors."""
        own = self._given(factors)
        windows = [(end, min(end + self.refit_freq, self.ends[-1])) for end in self.ends]
        if self._fitted is None or tuple(f.key for f in own) != self._fitted[1] or not panel.df.sameSemantics(self._fitted[0]):
            return self._predicted(self._ranked(panel, own), windows if _grid_of(panel.df) == self.grid else None)
        if self._predictions is None:
            self._predictions = written(self._predicted(self._fitted[2], windows), "predictions")
        return self._predictions

    def _predicted(self, df: DataFrame, windows: list[tuple[int, int]] | None) -> DataFrame:
        """Values of a ranked panel by each refit's window of rows, or by the last model."""
        keys = ["date", "t_idx", "symbol", "symbol_pos"]
        names = [f"x{i}" for i in range(len(self.factors))]
        rest = (self.min_train_periods, np.iinfo(np.int32).max)
        if self.forest:
            trained = [r for r in range(len(self.forest.ends)) if self.forest.trained(r)]
            own = [(r, *windows[r]) for r in trained] if windows else [(r, *rest) for r in trained[-1:]]
            return predict(df, len(names), self.forest, own, keys)
        if self.boosted:
            full = df.dropna(subset=names)
            own = self.boosted if windows else [(*rest, self.boosted[-1][2])]
            parts = [m.transform(full.where((F.col("t_idx") >= a) & (F.col("t_idx") < b))).select("t_idx", "symbol", F.col("prediction").alias("value")) for a, b, m in own if a < b]
            found = parts[0]
            for p in parts[1:]:
                found = found.unionByName(p)
            return df.select(*keys).join(found, ["t_idx", "symbol"], "left").select(*keys, "value")
        if not self.blocks:
            return df.select(*keys, F.lit(None).cast("double").alias("value"))

        def value(intercept: Any, coef: Any) -> Any:
            return sum((coef[i] * F.col(n) for i, n in enumerate(names)), intercept)

        if windows is None:
            last = self.blocks[-1]
            return df.select(*keys, F.when(F.col("t_idx") >= self.min_train_periods, value(F.lit(last["intercept"]), [F.lit(w) for w in last["coef"]])).alias("value"))
        rows = [(t, b["intercept"], b["coef"]) for b in self.blocks for t in range(b["start"], b["stop"])]
        table = broadcast_if_small(df.sparkSession.createDataFrame(rows, "t_idx int, b double, w array<double>"))  # a row for each date
        return df.join(table, "t_idx", "left").select(*keys, value(F.col("b"), F.col("w")).alias("value"))

    def save(self, spark: SparkSession, path: str, save_predictions: bool = False) -> None:
        """Parameters and coefficients as JSON at ``path/model``, trees as a table of nodes at ``path/nodes``.

        With ``save_predictions`` those of the fitted panel go to ``path/predictions``.
        """
        if self.boosted:
            raise TypeError("boosted models are saved one by one with their own write()")
        kept = ("model_type", "min_train_periods", "refit_freq", "ridge_alpha", "rf_n_estimators", "rf_max_depth", "purge", "grid", "ends", "blocks")
        _save_json(spark, path, {"kind": "ml", **{k: getattr(self, k) for k in kept}, "importances": self.importances.tolist()})
        if self.forest:
            self.forest.to_table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        if save_predictions and self._fitted:
            self.predict(Panel(self._fitted[0])).write.mode("overwrite").parquet(f"{path}/predictions")

    @classmethod
    def load(cls, spark: SparkSession, path: str, factors: Sequence[Any], panel: Panel | None = None) -> MLCombiner:
        """The saved model; given the panel it was fitted on, saved predictions are returned for it."""
        state = _load_json(spark, path, "ml")
        out = cls(**{k: state[k] for k in ("model_type", "min_train_periods", "refit_freq", "ridge_alpha", "rf_n_estimators", "rf_max_depth", "purge")})
        out.grid, out.ends, out.blocks, out.importances, out.factors = state["grid"], state["ends"], state["blocks"], np.array(state["importances"]), tuple(map(as_expr, factors))
        if out.model_type == "random_forest":
            out.forest = Forest.from_table(spark.read.parquet(f"{path}/nodes"), out.ends, out.rf_n_estimators, out.rf_max_depth)
        if panel is not None:
            out._fitted = panel.df, tuple(f.key for f in out.factors), out._ranked(panel, out.factors)
            jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/predictions")
            if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
                out._predictions = spark.read.parquet(f"{path}/predictions")
        return out


def _grid_of(df: DataFrame) -> list[str]:
    """What tells a panel's dates and symbols from others'."""
    return [str(v) for v in df.agg(F.count("*"), F.sum(F.xxhash64("date", "t_idx", F.col("symbol").cast("string")).cast("decimal(38,0)"))).first()]
