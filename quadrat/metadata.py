"""Labels, value labels, measurement types and labelling schemes, kept beside the data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.errors import LabelError

#: Measurement types.
TYPES = ("continuous", "discrete", "nominal", "ordinal", "boolean", "datetime", "string")
#: Kinds of missing answers that a value label may carry.
MISSING_KINDS = ("refused", "dont_know", "no_answer", "not_applicable", "structural", "system")
_BY_TYPE = {"tinyint": "discrete", "smallint": "discrete", "int": "discrete", "bigint": "discrete", "float": "continuous", "double": "continuous", "boolean": "boolean", "string": "string", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}


@dataclass(frozen=True)
class Scheme:
    """A named set of value labels that several variables may share."""

    id: str
    mapping: tuple[tuple[Any, str], ...]
    title: str = ""
    locale: str = ""
    ordered: bool = False
    missing: tuple[Any, ...] = ()

    def labels(self) -> dict:
        return dict(self.mapping)


class LabellingCatalog:
    """Schemes by id; saved as JSON."""

    def __init__(self, schemes: list[Scheme] | None = None):
        self._schemes: dict[str, Scheme] = {s.id: s for s in schemes or []}

    def register(self, scheme: Scheme, *, overwrite: bool = False) -> LabellingCatalog:
        if scheme.id in self._schemes and not overwrite:
            raise LabelError(f"scheme {scheme.id} is there already", where="register")
        self._schemes[scheme.id] = scheme
        return self

    def register_many(self, schemes: list[Scheme], *, overwrite: bool = False) -> LabellingCatalog:
        for s in schemes:
            self.register(s, overwrite=overwrite)
        return self

    def add_scheme(self, id: str, mapping: dict, **kw) -> LabellingCatalog:
        return self.register(Scheme(id, tuple(mapping.items()), **kw))

    def add_schemes(self, schemes: dict[str, dict]) -> LabellingCatalog:
        for k, v in schemes.items():
            self.add_scheme(k, v)
        return self

    def get(self, id: str) -> Scheme:
        if id not in self._schemes:
            raise LabelError(f"no such scheme: {id}", where="get")
        return self._schemes[id]

    def remove(self, id: str) -> LabellingCatalog:
        self._schemes.pop(id, None)
        return self

    def list(self) -> list[str]:
        return sorted(self._schemes)

    def search(self, text: str) -> list[Scheme]:
        t = text.lower()
        return [s for s in self._schemes.values() if t in s.id.lower() or t in s.title.lower() or any(t in str(v).lower() for _, v in s.mapping)]

    def pick(self, *ids: str) -> list[Scheme]:
        return [self.get(i) for i in ids]

    def to_label(self, id: str, value: Any) -> str | None:
        return self.get(id).labels().get(value)

    def to_bytes(self) -> bytes:
        return json.dumps([asdict(s) for s in self._schemes.values()]).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> LabellingCatalog:
        made = [Scheme(**{**x, "mapping": tuple((k, v) for k, v in x["mapping"]), "missing": tuple(x["missing"])}) for x in json.loads(data)]
        return cls(made)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def load(cls, path: str) -> LabellingCatalog:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())


@dataclass(frozen=True)
class Variable:
    name: str
    label: str | None = None
    value_labels: tuple[tuple[Any, str], ...] = ()
    scheme: str | None = None
    type: str | None = None
    categories: tuple[Any, ...] = ()
    ordered: bool = False
    source: str = "user"


@dataclass(frozen=True)
class MetadataStore:
    """Immutable: every change gives a new store."""

    catalog: LabellingCatalog | None = None
    variables: dict[str, Variable] = field(default_factory=dict)

    def get(self, name: str) -> Variable | None:
        return self.variables.get(name)

    def require(self, name: str) -> Variable:
        if name not in self.variables:
            raise LabelError(f"no metadata for {name}", where="require")
        return self.variables[name]

    def set(self, variable: Variable) -> MetadataStore:
        return replace(self, variables=self.variables | {variable.name: variable})

    def _change(self, name: str, **kw) -> MetadataStore:
        return self.set(replace(self.variables.get(name) or Variable(name), **kw))

    def remove(self, name: str) -> MetadataStore:
        return replace(self, variables={k: v for k, v in self.variables.items() if k != name})

    def set_label(self, name: str, label: str) -> MetadataStore:
        return self._change(name, label=label)

    def set_labels(self, labels: dict[str, str]) -> MetadataStore:
        out = self
        for k, v in labels.items():
            out = out.set_label(k, v)
        return out

    def set_value_labels(self, name: str, labels: dict) -> MetadataStore:
        if len(set(labels.values())) < len(labels):
            raise LabelError("two values have the same label", where="set_value_labels", param=name)
        return self._change(name, value_labels=tuple(labels.items()), scheme=None)

    def set_scheme(self, name: str, scheme: str) -> MetadataStore:
        if self.catalog is None:
            raise LabelError("the store has no catalog", where="set_scheme")
        self.catalog.get(scheme)
        return self._change(name, scheme=scheme, value_labels=())

    def set_type(self, name: str, kind: str) -> MetadataStore:
        if kind not in TYPES:
            raise LabelError(f"no such measurement type: {kind}", param="kind")
        return self._change(name, type=kind)

    def set_categories(self, name: str, categories: list, ordered: bool = False) -> MetadataStore:
        return self._change(name, categories=tuple(categories), ordered=ordered, type="ordinal" if ordered else "nominal")

    def resolve_labels(self, name: str) -> dict:
        v = self.variables.get(name)
        if v is None:
            return {}
        if v.scheme and self.catalog:
            return self.catalog.get(v.scheme).labels()
        return dict(v.value_labels)

    def resolve_all(self) -> dict[str, dict]:
        return {n: found for n in self.variables if (found := self.resolve_labels(n))}

    def labels(self) -> dict[str, str]:
        return {n: v.label for n, v in self.variables.items() if v.label}

    def rename_variables(self, renames: dict[str, str]) -> MetadataStore:
        return replace(self, variables={(n := renames.get(k, k)): replace(v, name=n) for k, v in self.variables.items()})

    def infer_from_dataframe(self, df: DataFrame, *, nominal_limit: int | None = None) -> MetadataStore:
        """Measurement types from column types.

        With ``nominal_limit`` string columns of at most so many distinct values
        become nominal; that costs one pass, so it is asked for, not assumed.
        """
        out = self
        few: set[str] = set()
        strings = [c for c, t in df.dtypes if t == "string"]
        if nominal_limit and strings:
            n = df.agg(*[F.approx_count_distinct(c).alias(c) for c in strings]).first()
            few = {c for c in strings if n[c] <= nominal_limit}
        for c, t in df.dtypes:
            if out.get(c) is None or out.get(c).type is None:
                out = out._change(c, type="nominal" if c in few else _BY_TYPE.get(t, "string"), source="inferred")
        return out

    def import_from_schema(self, df: DataFrame) -> MetadataStore:
        """Labels from the fields' metadata (keys ``label`` and ``value_labels``)."""
        out = self
        for f in df.schema.fields:
            if "label" in (m := f.metadata or {}):
                out = out._change(f.name, label=m["label"], source="imported")
            if "value_labels" in m:
                out = out._change(f.name, value_labels=tuple((_number(k), v) for k, v in m["value_labels"].items()), source="imported")
        return out

    def update(self, other: MetadataStore, *, overwrite: bool = True) -> MetadataStore:
        merged = {**self.variables, **other.variables} if overwrite else {**other.variables, **self.variables}
        return replace(self, variables=merged, catalog=self.catalog or other.catalog)

    def align_to_dataframe(self, df: DataFrame) -> MetadataStore:
        return replace(self, variables={k: v for k, v in self.variables.items() if k in df.columns})

    def summary(self) -> list[dict]:
        return [{"name": v.name, "label": v.label, "type": v.type, "n_labels": len(self.resolve_labels(v.name)), "scheme": v.scheme, "source": v.source} for v in self.variables.values()]

    def inspect(self, name: str) -> dict:
        return asdict(self.require(name)) | {"resolved": self.resolve_labels(name)}

    def coverage(self, df: DataFrame) -> dict[str, float]:
        n = max(len(df.columns), 1)
        return {"label": sum(c in self.labels() for c in df.columns) / n, "value_labels": sum(bool(self.resolve_labels(c)) for c in df.columns) / n}

    def unlabeled(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.labels()]

    def orphaned(self, df: DataFrame) -> list[str]:
        return [n for n in self.variables if n not in df.columns]


def _number(text: str) -> Any:
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text
