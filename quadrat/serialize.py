"""Results as JSON with a kind and a schema version, and back."""

from __future__ import annotations

import json
import math
from typing import Any

from quadrat.errors import SerializationError
from quadrat.operators.categorical import Table, TestResult
from quadrat.operators.describe import DescribeResult
from quadrat.operators.estimation import Estimate
from quadrat.operators.regression import GLMFit
from quadrat.operators.size import SampleSize

VERSION = "1.0"


def _plain(x: Any) -> Any:
    """JSON values only: NaN and infinities as text, arrays as lists, keys as text."""
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    if isinstance(x, float) and not math.isfinite(x):
        return {"$float": "nan" if math.isnan(x) else "inf" if x > 0 else "-inf"}
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    return str(x)


def _back(x: Any) -> Any:
    if isinstance(x, dict):
        return float(x["$float"]) if set(x) == {"$float"} else {k: _back(v) for k, v in x.items()}
    return [_back(v) for v in x] if isinstance(x, list) else x


def to_dict(result: Any) -> dict:
    kinds = {
        Estimate: lambda r: ("estimate", {"param": r.param, "method": r.method, "by": r.by, "alpha": r.alpha, "estimates": r.rows()}),
        Table: lambda r: ("table", r.to_dict()),
        TestResult: lambda r: (r.kind, {"rows": r.rows}),
        GLMFit: lambda r: ("glm", {"y": r.y, "family": r.family, "link": r.link, "coefs": r.coefs(), "cov": r.cov, "df": r.df, "stats": r.stats}),
        DescribeResult: lambda r: ("describe", {"items": r.items}),
        SampleSize: lambda r: ("sample_size", {"param": r.param, "target": r.target, "rows": r.rows()}),
    }
    if type(result) not in kinds:
        raise SerializationError(f"{type(result).__name__} cannot be written", where="to_dict")
    kind, body = kinds[type(result)](result)
    return {"kind": kind, "schema_version": VERSION} | _plain(body)


def to_json(result: Any, **kw) -> str:
    return json.dumps(to_dict(result), **kw)


serialize = to_json


def from_json(text: str | bytes, kind: str | None = None) -> dict:
    """The payload with its floats; a wrong kind or a newer major version is an error."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise SerializationError("this is no JSON", where="from_json") from e
    if not isinstance(found, dict) or "kind" not in found:
        raise SerializationError("the payload has no kind", where="from_json")
    if kind and found["kind"] != kind:
        raise SerializationError(f"the payload is a {found['kind']}, not a {kind}", where="from_json")
    if str(found.get("schema_version", "0")).split(".")[0] != VERSION.split(".")[0]:
        raise SerializationError(f"schema version {found.get('schema_version')} is not known", where="from_json")
    return _back(found)
