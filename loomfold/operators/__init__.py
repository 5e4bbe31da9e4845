"""All factor operators under one name, ``ops``."""

from __future__ import annotations

from types import SimpleNamespace

from . import crosssection, market, timeseries

ops = SimpleNamespace(**{k: v for m in (timeseries, crosssection, market) for k, v in vars(m).items() if k[0].isupper() and callable(v) and getattr(v, "__module__", "") == m.__name__})
