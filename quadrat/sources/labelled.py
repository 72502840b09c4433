"""Values with labels, tagged missing values, and functions that strip or apply them."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.errors import LabelError


@dataclass(frozen=True)
class Labelled:
    """A column's values with a label for some, and a label of the column."""

    values: tuple
    labels: dict = field(default_factory=dict)
    label: str | None = None

    def label_of(self, value: Any) -> str | None:
        return next((k for k, v in self.labels.items() if v == value), None)


@dataclass(frozen=True)
class LabelledSpss(Labelled):
    """As ``Labelled``, with values and a range that the user declared missing."""

    na_values: tuple = ()
    na_range: tuple | None = None

    def is_missing(self, value: Any) -> bool:
        if value is None or value in self.na_values:
            return True
        return self.na_range is not None and self.na_range[0] <= value <= self.na_range[1]


def labelled(values, labels=None, label=None) -> Labelled:
    return Labelled(tuple(values), dict(labels or {}), label)


def labelled_spss(values, labels=None, na_values=None, na_range=None, label=None) -> LabelledSpss:
    if na_range and na_range[0] >= na_range[1]:
        raise LabelError("na_range must increase", param="na_range")
    return LabelledSpss(tuple(values), dict(labels or {}), label, tuple(na_values or ()), tuple(na_range) if na_range else None)


def is_labelled(x) -> bool:
    return isinstance(x, Labelled)


def is_labelled_spss(x) -> bool:
    return isinstance(x, LabelledSpss)


# ---- tagged missing values: a NaN whose payload holds a letter ------------------------
def tagged_na(tag: str) -> float:
    if len(tag) != 1:
        raise LabelError("a tag is one character", param="tag")
    return struct.unpack("<d", struct.pack("<Q", 0x7FF8000000000000 | ord(tag) << 24))[0]


def na_tag(x: Any) -> str | None:
    if not isinstance(x, float) or not math.isnan(x):
        return None
    code = struct.unpack("<Q", struct.pack("<d", x))[0] >> 24 & 0xFF
    return chr(code) if code else None


def is_tagged_na(x: Any, tag: str | None = None) -> bool:
    found = na_tag(x)
    return found is not None and (tag is None or found == tag)


def format_tagged_na(x: Any) -> str:
    found = na_tag(x)
    return f"NA({found})" if found else "NA" if x is None or (isinstance(x, float) and math.isnan(x)) else str(x)


def print_tagged_na(values) -> str:
    return " ".join(format_tagged_na(v) for v in values)


# ---- over DataFrames; labels live in the fields' metadata ----------------------------
def with_metadata(df: DataFrame, name: str, **meta) -> DataFrame:
    old = dict(df.schema[name].metadata or {})
    new = {k: v for k, v in (old | meta).items() if v is not None}
    return df.withMetadata(name, new)


def value_labels(df: DataFrame, name: str) -> dict:
    """{code: label} of a column, codes as the column's own type."""
    number = df.schema[name].dataType.simpleString() != "string"
    return {(float(k) if number else k): v for k, v in (df.schema[name].metadata or {}).get("value_labels", {}).items()}


def column_labels(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["label"] for f in df.schema.fields if (f.metadata or {}).get("label")}


def user_missing(df: DataFrame, name: str) -> dict:
    return (df.schema[name].metadata or {}).get("user_missing", {})


def as_factor(df: DataFrame, columns=None, levels: str = "default") -> DataFrame:
    """Codes to labels: default (label, else the value), labels (else null), values, both ("[code] label")."""
    if levels not in ("default", "labels", "values", "both"):
        raise LabelError("levels must be default, labels, values or both", param="levels")
    names = [c for c in (columns or df.columns) if value_labels(df, c)]
    out = {}
    for c in names:
        plain = F.col(c).cast("string")
        if dict(df.dtypes)[c] in ("double", "float"):
            plain = F.when(F.col(c) == F.floor(c), F.col(c).cast("bigint").cast("string")).otherwise(plain)
        pairs = [F.lit(x) for k, v in value_labels(df, c).items() for x in (k, v)]
        found = F.create_map(*pairs)[F.col(c)]
        out[c] = {"default": F.coalesce(found, plain), "labels": found, "values": plain, "both": F.coalesce(F.concat(F.lit("["), plain, F.lit("] "), found), plain)}[levels]
    return df.withColumns(out) if out else df


apply_value_labels = as_factor


def zap_label(df: DataFrame, columns=None) -> DataFrame:
    for c in columns or df.columns:
        df = with_metadata(df, c, label=None)
    return df


def zap_labels(df: DataFrame, columns=None, user_na: bool = False) -> DataFrame:
    if user_na:
        df = zap_missing(df, columns)
    for c in columns or df.columns:
        df = with_metadata(df, c, value_labels=None)
    return df


def zap_formats(df: DataFrame, columns=None) -> DataFrame:
    for c in columns or df.columns:
        df = with_metadata(df, c, format=None)
    return df


def zap_widths(df: DataFrame, columns=None) -> DataFrame:
    for c in columns or df.columns:
        df = with_metadata(df, c, display_width=None)
    return df


def zap_empty(df: DataFrame, columns=None) -> DataFrame:
    """Empty strings become null."""
    names = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in names}) if names else df


def zap_missing(df: DataFrame, columns=None) -> DataFrame:
    """Values declared missing become null, and their declarations go."""
    for c in columns or df.columns:
        spec = user_missing(df, c)
        if not spec:
            continue
        bad = F.lit(False)
        if spec.get("values"):
            bad = bad | F.col(c).isin(spec["values"])
        if spec.get("range"):
            bad = bad | F.col(c).between(*spec["range"])
        meta = {k: v for k, v in (df.schema[c].metadata or {}).items() if k != "user_missing"}
        df = df.withColumn(c, F.when(~bad, F.col(c))).withMetadata(c, meta)
    return df


def combine_labels(first: dict, second: dict) -> dict:
    """Labels of both; a label that means two values is an error."""
    clash = [k for k in first if k in second and first[k] != second[k]]
    if clash:
        raise LabelError(f"labels with two values: {clash}", where="combine_labels")
    return {**first, **second}
