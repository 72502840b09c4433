"""A sample: a DataFrame bound to its sampling design.  Every operation returns a new one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.design import Design, RepWeights
from quadrat.errors import ColumnError, MethodError
from quadrat.metadata import LabellingCatalog, MetadataStore
from quadrat.plans.where import predicate

_ACCESSORS: dict[str, Any] = {}


def register_sample_accessor(name: str):
    """Class decorator: ``sample.<name>`` gives an instance built from the sample."""

    def add(cls):
        _ACCESSORS[name] = cls
        return cls

    return add


class Sample:
    """Rows, design, labels and warnings.

    NaN and infinite values of float columns count as missing everywhere; they
    are turned into nulls here once, as part of the plan.
    """

    def __init__(self, data: DataFrame, design: Design | None = None, *, catalog: LabellingCatalog | None = None, _meta: MetadataStore | None = None, _warnings: tuple = (), _singleton: dict | None = None, _clean: bool = False):
        design = design or Design()
        lost = [c for c in design.specified_fields() if c not in data.columns]
        if lost:
            raise ColumnError(f"the design names columns the data does not have: {', '.join(lost)}", where="Sample")
        if not _clean:
            floats = [f.name for f in data.schema.fields if f.dataType.simpleString() in ("double", "float")]
            if floats:
                data = data.withColumns({c: F.when(~F.isnan(f"`{c}`") & (F.abs(f"`{c}`") != float("inf")), F.col(f"`{c}`")) for c in floats})
        self._data, self._design = data, design
        self.meta = _meta or MetadataStore(catalog)
        self.warnings: tuple = _warnings
        self._singleton = _singleton or {}

    def _with(self, data: DataFrame | None = None, design: Design | None = None, **kw) -> Sample:
        given = {"_meta": self.meta, "_warnings": self.warnings, "_singleton": self._singleton, "_clean": True}
        return Sample(self._data if data is None else data, design or self._design, **(given | kw))

    def __getattr__(self, name: str):
        if name.startswith("__") or name not in _ACCESSORS:
            raise AttributeError(name)
        return _ACCESSORS[name](self)

    data = property(lambda self: self._data)
    design = property(lambda self: self._design)
    rep_wgts: RepWeights | None = property(lambda self: self._design.rep_wgts)
    fpc = property(lambda self: self._design.pop_size)
    labels = property(lambda self: self.meta.labels())

    @property
    def estimation(self):
        from quadrat.operators.estimation import Estimation

        return Estimation(self)

    @property
    def categorical(self):
        from quadrat.operators.categorical import Categorical

        return Categorical(self)

    @property
    def glm(self):
        from quadrat.operators.regression import GLM

        return GLM(self)

    @property
    def weighting(self):
        from quadrat.operators.weighting import Weighting

        return Weighting(self)

    @property
    def sampling(self):
        from quadrat.operators.selection import Selection

        return Selection(self)

    @property
    def wrangling(self):
        from quadrat.operators.wrangling import Wrangling

        return Wrangling(self)

    @property
    def singleton(self):
        from quadrat.operators.singleton import Singleton

        return Singleton(self)

    # counts
    n_records = property(lambda self: self._data.count())
    n_columns = property(lambda self: len(self._data.columns))
    dtypes = property(lambda self: dict(self._data.dtypes))

    def _distinct(self, cols: tuple[str, ...]) -> DataFrame | None:
        return self._data.select(*cols).distinct() if cols else None

    strata = property(lambda self: self._distinct(self._design.strata))
    psus = property(lambda self: self._distinct((*self._design.strata, *self._design.psus) if self._design.psu else ()))
    ssus = property(lambda self: self._distinct((*self._design.strata, *self._design.psus, *self._design.ssus) if self._design.ssu else ()))
    n_strata = property(lambda self: s.count() if (s := self.strata) is not None else 0)
    n_psus = property(lambda self: s.count() if (s := self.psus) is not None else 0)

    @property
    def deff_w(self) -> float | None:
        """Kish's effect of weighting, 1 + relative variance of the weights."""
        if not self._design.wgt:
            return None
        r = self._data.agg(F.var_pop(self._design.wgt), F.avg(self._design.wgt)).first()
        return 1 + r[0] / r[1] ** 2

    # labels and types
    def set_var_label(self, name: str, label: str) -> Sample:
        return self._with(_meta=self.meta.set_label(name, label))

    def set_var_labels(self, labels: dict[str, str]) -> Sample:
        return self._with(_meta=self.meta.set_labels(labels))

    def set_value_labels(self, name: str, labels: dict) -> Sample:
        return self._with(_meta=self.meta.set_value_labels(name, labels))

    def use_scheme(self, name: str, scheme: str) -> Sample:
        return self._with(_meta=self.meta.set_scheme(name, scheme))

    def resolve_labels(self, name: str) -> dict:
        return self.meta.resolve_labels(name)

    def set_type(self, name: str, kind: str) -> Sample:
        return self._with(_meta=self.meta.set_type(name, kind))

    def set_categories(self, name: str, categories: list, ordered: bool = False) -> Sample:
        return self._with(_meta=self.meta.set_categories(name, categories, ordered))

    # data and design
    def set_data(self, data: DataFrame) -> Sample:
        return self._with(data, _clean=False)

    update_data = set_data

    def set_design(self, design: Design) -> Sample:
        return self._with(design=design, _singleton={})

    def update_design(self, **changes) -> Sample:
        return self._with(design=self._design.update(**changes))

    def use_weight(self, name: str) -> Sample:
        """Another column as the main weight; replicate weights of the old one are dropped."""
        if name not in self._data.columns:
            raise ColumnError(f"no such column: {name}", where="use_weight")
        keep = self._design.rep_wgts if name == self._design.wgt else None
        return self._with(design=self._design.update(wgt=name, rep_wgts=keep))

    def clone(self) -> Sample:
        return self._with()

    def warn(self, code: str, message: str, **more) -> Sample:
        return self._with(_warnings=(*self.warnings, {"code": code, "message": message} | more))

    def show_data(self, columns: list[str] | None = None, *, where=None, n: int | None = 5, offset: int = 0, order_by=None, order_type: str = "ascending", nulls_last: bool = False, rstate: int | None = None) -> DataFrame:
        """A view of some rows: filtered, ordered, from ``offset``; ``order_type='random'`` shuffles."""
        df = self._data
        if (p := predicate(where)) is not None:
            df = df.where(p)
        if order_type == "random":
            df = df.orderBy(F.rand(rstate if rstate is not None else 0))
        elif order_by:
            keys = [order_by] if isinstance(order_by, str) else list(order_by)
            df = df.orderBy(*[(F.col(k).desc_nulls_last() if nulls_last else F.col(k).desc_nulls_first()) if order_type == "descending" else (F.col(k).asc_nulls_last() if nulls_last else F.col(k).asc_nulls_first()) for k in keys])
        if columns:
            df = df.select(*columns)
        if offset:
            df = df.offset(offset)
        return df if n is None else df.limit(n)

    def describe(self, columns: list[str] | None = None, **kw):
        from quadrat.operators.describe import describe

        return describe(self, columns, **kw)

    def require_weight(self, where: str) -> str:
        if not self._design.wgt:
            raise MethodError("the design has no weight column", where=where)
        return self._design.wgt
