"""A local catalog of datasets by name: load with filter, projection, order and rows per group."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.errors import DatasetError
from quadrat.plans.where import predicate


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    format: str = "parquet"
    title: str = ""
    sha256: str | None = None


_CATALOG: dict[str, Dataset] = {}


def validate_slug(name: str) -> str:
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", name):
        raise DatasetError(f"not a dataset name: {name}", param="name")
    return name


def register(dataset: Dataset) -> None:
    _CATALOG[validate_slug(dataset.name)] = dataset


def catalog() -> list[Dataset]:
    return sorted(_CATALOG.values(), key=lambda d: d.name)


def describe(name: str) -> Dataset:
    if name not in _CATALOG:
        raise DatasetError(f"no such dataset: {name}", where="describe", hint=f"there are {', '.join(sorted(_CATALOG)) or 'none'}")
    return _CATALOG[name]


def clear() -> None:
    _CATALOG.clear()


def verify(name: str) -> bool:
    """Whether a single-file dataset has the checksum it was registered with."""
    d = describe(name)
    if d.sha256 is None:
        return True
    with open(d.path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == d.sha256


def load(name: str, *, n=None, rate=None, by=None, where=None, select=None, order_by=None, order_type="ascending", rstate=None, spark: SparkSession | None = None) -> DataFrame:
    """Filter, then project, order, and take ``n`` rows or a share of them, per group if ``by`` is given."""
    d = describe(name)
    session = spark or SparkSession.getActiveSession()
    df = session.read.format(d.format).load(d.path) if d.format != "csv" else session.read.csv(d.path, header=True, inferSchema=True)
    if (p := predicate(where)) is not None:
        df = df.where(p)
    by = [by] if isinstance(by, str) else list(by or [])
    if select:
        keep = [select] if isinstance(select, str) else list(select)
        df = df.select(*dict.fromkeys([*keep, *by]))
    if order_type not in ("ascending", "descending", "random"):
        raise DatasetError("order_type must be ascending, descending or random", param="order_type")
    if order_type == "random":
        keys = [F.rand(rstate or 0)]
    else:
        cols = [order_by] if isinstance(order_by, str) else list(order_by or [])
        keys = [F.desc(c) if order_type == "descending" else F.asc(c) for c in cols]
    if n is not None and rate is not None:
        raise DatasetError("give either n or rate", where="load")
    if by and (n is not None or rate is not None):
        w = Window.partitionBy(*by).orderBy(*(keys or [F.monotonically_increasing_id()]))
        most = F.lit(n) if n is not None else F.ceil(F.count("*").over(Window.partitionBy(*by)) * rate)
        return df.withColumns({"__k": F.row_number().over(w), "__m": most}).where("__k <= __m").drop("__k", "__m")
    df = df.orderBy(*keys) if keys else df
    if rate is not None:
        n = -(-df.count() * rate // 1)
    return df.limit(int(n)) if n is not None else df
