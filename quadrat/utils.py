"""Checks, seeds, weighted quantiles and logging."""

from __future__ import annotations

import logging
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.errors import DimensionError, MissingValueError
from quadrat.operators.weighting import hadamard  # noqa: F401
from quadrat.plans.where import missing


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null, NaN or infinite values in the columns."""
    types = dict(df.dtypes)
    for c in columns or df.columns:
        df = df.where(~missing(F.col(c), types[c]))
    return df


def assert_no_missing(df: DataFrame, columns: list[str] | None = None) -> None:
    """One aggregation; the error names each column and its count."""
    types, columns = dict(df.dtypes), columns or df.columns
    n = df.agg(*[F.count_if(missing(F.col(c), types[c])).alias(c) for c in columns]).first()
    if bad := {c: n[c] for c in columns if n[c]}:
        raise MissingValueError("; ".join(f"{c}: {k} missing" for c, k in bad.items()), where="assert_no_missing")


def as_float64_1d(values) -> np.ndarray:
    out = np.asarray(values, np.float64)
    if out.ndim != 1:
        raise DimensionError("one dimension is asked for", where="as_float64_1d")
    return out


def check_same_length(*arrays) -> None:
    if len({len(a) for a in arrays}) > 1:
        raise DimensionError("the arrays differ in length", where="check_same_length")


def check_weights_finite_positive(w) -> None:
    w = as_float64_1d(w)
    if not (np.isfinite(w).all() and (w > 0).all()):
        raise DimensionError("weights must be finite and positive", where="check_weights")


def weighted_quantiles(values, weights, ps) -> np.ndarray:
    """First value whose share of the weight reaches each p; for arrays on the driver."""
    x, w = as_float64_1d(values), as_float64_1d(weights)
    check_same_length(x, w)
    order = np.argsort(x, kind="stable")
    cdf = np.cumsum(w[order]) / w.sum()
    return x[order][np.minimum(np.searchsorted(cdf, np.asarray(ps) - 1e-12), len(x) - 1)]


def weighted_quantile_bins(values, weights, k: int) -> np.ndarray:
    """Edges of ``k`` bins of equal weight, without repeats."""
    x = as_float64_1d(values)
    inner = weighted_quantiles(x, weights, np.arange(1, k) / k)
    return np.unique(np.concatenate([[x.min()], inner, [x.max()]]))


def resolve_random_state(state=None) -> np.random.Generator:
    return state if isinstance(state, np.random.Generator) else np.random.default_rng(state)


def seed_from_random_state(state=None) -> int:
    return int(state) if isinstance(state, (int, np.integer)) else int(resolve_random_state(state).integers(0, 2**31 - 1))


def spawn_child_rngs(state, n: int) -> list[np.random.Generator]:
    return [np.random.default_rng(s) for s in np.random.SeedSequence(seed_from_random_state(state)).spawn(n)]


def enable_logging(level: int | str = logging.INFO) -> logging.Logger:
    log = logging.getLogger("quadrat")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log


def enable_debug() -> logging.Logger:
    return enable_logging(logging.DEBUG)


@contextmanager
def temporary_log_level(level: int | str):
    log = logging.getLogger("quadrat")
    before = log.level
    log.setLevel(level)
    try:
        yield log
    finally:
        log.setLevel(before)
