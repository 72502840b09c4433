"""Data preparation: rows, columns, values and labels.  Every call gives a new sample."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.errors import ColumnError, LabelError, MethodError
from quadrat.functions.expr import INDEX, Expr, Scope, col, compute
from quadrat.plans.where import predicate


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _names_in(expr: Expr, known: set[str]) -> set[str]:
    """Columns of ``known`` that an expression mentions, read from its plan text."""
    scope = Scope()
    found = [expr.build(scope), *scope.scalars.values(), *[c for m in scope.moves.values() for c in (m.place, m.value)]]
    text = " ".join(str(c._jc.toString()) for c in found)
    return {k for k in known if re.search(rf"(?<![\w`]){re.escape(k)}(?![\w])", text)}


def clean_name(name: str, case_style: str = "snake", letter_case: str = "lower", remove: str | None = None, minimal: bool = False) -> str:
    if remove:
        name = re.sub(remove, "", name)
    if minimal:
        return re.sub(r"\s+", "_", name.strip())
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", spaced)
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", spaced) if p] or ["column"]
    if case_style == "snake":
        out = "_".join(parts)
    elif case_style == "kebab":
        out = "-".join(parts)
    elif case_style in ("camel", "pascal"):
        out = "".join(p[:1].upper() + p[1:].lower() for p in parts)
        return out[:1].lower() + out[1:] if case_style == "camel" else out
    else:
        raise MethodError(f"no such case style: {case_style}", param="case_style")
    return {"lower": out.lower, "upper": out.upper, "title": out.title, "original": lambda: out}[letter_case]()


def _carried(df: DataFrame, cols: list[str], forward: bool) -> DataFrame:
    """Nulls of ``cols`` filled with the known value nearest before, or after, in the table's order.

    Rows are filled within their partition; what a partition hands on is one row, so
    only a row per partition is put in order by one task.
    """
    marked = df.withColumns({"__part": F.spark_partition_id(), INDEX: F.monotonically_increasing_id()}).persist()
    way = F.asc if forward else F.desc
    best = F.max_by if forward else F.min_by
    ends = marked.groupBy("__part").agg(*[best(F.col(c), F.when(F.col(c).isNotNull(), F.col(INDEX))).alias(f"__end{j}") for j, c in enumerate(cols)])
    before = Window.orderBy(way("__part")).rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("__part", *[F.last(f"__end{j}", ignorenulls=True).over(before).alias(f"__from{j}") for j in range(len(cols))])
    inside = Window.partitionBy("__part").orderBy(way(INDEX)).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__from{j}")) for j, c in enumerate(cols)}
    return marked.join(handed, "__part").withColumns(filled).orderBy(INDEX).select(*[F.col(f"`{c}`") for c in df.columns])


class Wrangling:
    def __init__(self, sample):
        self.sample = sample

    # ---- columns -----------------------------------------------------------
    def rename_columns(self, renames: dict[str, str], *, inplace=False):
        df = self.sample.data
        if lost := [c for c in renames if c not in df.columns]:
            raise ColumnError(f"no such column: {', '.join(lost)}", where="rename_columns")
        after = [renames.get(c, c) for c in df.columns]
        if len(set(after)) < len(after):
            raise ColumnError("two columns would have the same name", where="rename_columns")
        return self.sample._with(df.withColumnsRenamed(renames), self.sample.design.renamed(renames), _meta=self.sample.meta.rename_variables(renames))

    def clean_names(self, minimal=False, remove=None, case_style="snake", letter_case="lower", *, inplace=False):
        """Regular names; repeats get a number."""
        seen: dict[str, int] = {}
        renames = {}
        for c in self.sample.data.columns:
            n = clean_name(c, case_style, letter_case, remove, minimal)
            seen[n] = seen.get(n, 0) + 1
            renames[c] = n if seen[n] == 1 else f"{n}_{seen[n] - 1}"
        return self.rename_columns({k: v for k, v in renames.items() if k != v})

    def _guard(self, gone: list[str], force: bool, where: str) -> None:
        used = set(self.sample.design.specified_fields()) & set(gone)
        if used and not force:
            raise ColumnError(f"the design uses {', '.join(sorted(used))}", where=where, hint="force=True")

    def keep_columns(self, columns, *, force=False, inplace=False):
        columns = _list(columns)
        self._guard([c for c in self.sample.data.columns if c not in columns], force, "keep_columns")
        return self._dropped(self.sample.data.select(*columns))

    select = keep_columns

    def remove_columns(self, columns, *, force=False, inplace=False):
        columns = _list(columns)
        if lost := [c for c in columns if c not in self.sample.data.columns]:
            raise ColumnError(f"no such column: {', '.join(lost)}", where="remove_columns")
        self._guard(columns, force, "remove_columns")
        return self._dropped(self.sample.data.drop(*columns))

    drop = remove_columns

    def _dropped(self, df):
        d, left = self.sample.design, set(df.columns)
        gone = {r: None for r in ("row_index", "wgt", "prob", "hit", "mos") if getattr(d, r) and getattr(d, r) not in left}
        for r, cols in (("ssu", d.ssus), ("psu", d.psus), ("stratum", d.strata)):
            if cols and not set(cols) <= left:
                gone[r] = None
                if r == "psu":
                    gone["ssu"] = None
        if d.pop_size and d.pop_size.psu not in left:
            gone["pop_size"] = None
        if d.rep_wgts and not set([d.rep_wgts.array] if d.rep_wgts.array else d.rep_wgts.columns) <= left:
            gone["rep_wgts"] = None
        return self.sample._with(df, d.update(**gone), _meta=self.sample.meta.align_to_dataframe(df))

    # ---- values ------------------------------------------------------------
    def _put(self, made: dict[str, tuple[Column, str]], replace: bool, into):
        """``made`` maps a column to its new value and the suffix of its default name."""
        out = {}
        for k, (c, suffix) in made.items():
            if isinstance(into, dict):
                name = into.get(k, f"survey_{k}_{suffix}")
            elif into:
                name = into if len(made) == 1 else f"{into}_{k}"
            else:
                name = k if replace else f"survey_{k}_{suffix}"
            out[name] = c
        return self.sample._with(self.sample.data.withColumns(out))

    def top_code(self, top_codes: dict, *, replace=False, into=None, inplace=False):
        return self._put({k: (F.when(F.col(k) >= b, F.lit(b)).otherwise(F.col(k)), "top_coded") for k, b in top_codes.items()}, replace, into)

    def bottom_code(self, bottom_codes: dict, *, replace=False, into=None, inplace=False):
        return self._put({k: (F.when(F.col(k) <= b, F.lit(b)).otherwise(F.col(k)), "bottom_coded") for k, b in bottom_codes.items()}, replace, into)

    def bottom_and_top_code(self, bottom_and_top_codes: dict, *, replace=False, into=None, inplace=False):
        made = {}
        for k, (lo, hi) in bottom_and_top_codes.items():
            if lo > hi:
                raise MethodError(f"the bottom code of {k} is above its top code", param="bottom_and_top_codes")
            made[k] = (F.when(F.col(k) <= lo, F.lit(lo)).when(F.col(k) >= hi, F.lit(hi)).otherwise(F.col(k)), "bottom_and_top_coded")
        return self._put(made, replace, into)

    def recode(self, cols, recodes: dict, *, replace=False, into=None, inplace=False):
        """``{new: [old, ...]}``; None matches null; what matches nothing stays."""
        made = {}
        for k in _list(cols):
            c, dtype = F.col(k), dict(self.sample.data.dtypes)[k]
            text = any(isinstance(n, str) for n in recodes) and dtype != "string"
            out = c.cast("string") if text else c
            for new, old in reversed(list(recodes.items())):
                values = list(old) if isinstance(old, (list, tuple, set)) else [old]
                hit = c.isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
                if None in values:
                    hit = F.coalesce(hit, F.lit(False)) | c.isNull()
                out = F.when(hit, F.lit(new)).otherwise(out)
            made[k] = (out, "recoded")
        return self._put(made, replace, into)

    def categorize(self, col: str, bins: list | None = None, labels: list | None = None, *, percentiles: list | None = None, right=True, replace=False, into=None, inplace=False):
        """Intervals by edges, or by weighted percentiles; the outermost edge is closed, outside is null."""
        if (bins is None) == (percentiles is None):
            raise MethodError("give either bins or percentiles", where="categorize")
        if percentiles is not None:
            bins = self._weighted_edges(col, percentiles)
        if len(bins) < 2 or any(a >= b for a, b in zip(bins, bins[1:])):
            raise MethodError("edges must increase", param="bins")
        shown = [f"({a}, {b}]" if right else f"[{a}, {b})" for a, b in zip(bins, bins[1:])]
        labels = labels or shown
        if len(labels) != len(bins) - 1:
            raise MethodError("there must be one label per interval", param="labels")
        c, out = F.col(col), F.lit(None).cast("string")
        n = len(labels)
        for k in range(n - 1, -1, -1):
            a, b = bins[k], bins[k + 1]
            hit = ((c > a) if k else (c >= a)) & (c <= b) if right else (c >= a) & ((c < b) if k < n - 1 else (c <= b))
            out = F.when(hit, F.lit(labels[k])).otherwise(out)
        return self._put({col: (out, "categorized")}, replace, into)

    def _weighted_edges(self, name: str, percentiles: list) -> list:
        """Values where the cumulative weight first reaches each share, between minimum and maximum."""
        from quadrat.operators.estimation import Estimation

        e = Estimation(self.sample)
        prep = e._prepare([name], None, None, True)
        ps = [p / 100 if p > 1 else float(p) for p in percentiles if 0 < p < 100]
        cdf = e._cdf(prep, name, F.col("__w"), "higher")
        got = e._points(cdf, [], {f"q{k}": float(p) for k, p in enumerate(ps)}, "higher").first() if ps else ()
        lo, hi = self.sample.data.agg(F.min(name), F.max(name)).first()
        return sorted({float(lo), *[float(v) for v in got], float(hi)})

    def cast(self, cols, dtype=None, *, strict=True, inplace=False):
        """Change types; a strict cast of fractions to integers is an error."""
        spec = cols if isinstance(cols, dict) else {c: dtype for c in _list(cols)}
        df, types = self.sample.data, dict(self.sample.data.dtypes)
        ints = ("tinyint", "smallint", "int", "bigint", "integer", "long", "short")
        if strict:
            risky = [c for c, t in spec.items() if types[c] in ("double", "float") and str(t).lower() in ints]
            if risky:
                bad = df.agg(*[F.count_if(F.col(c) != F.floor(c)).alias(c) for c in risky]).first()
                if lost := [c for c in risky if bad[c]]:
                    raise MethodError(f"fractions would be lost in {', '.join(lost)}", where="cast", hint="strict=False")
        change = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: F.col(c).try_cast(t))
        return self.sample._with(df.withColumns({c: change(c, t) for c, t in spec.items()}))

    cast_columns = cast

    def fill_null(self, cols, value=None, *, strategy=None, inplace=False):
        """A constant, or forward, backward, mean, min, max, zero or one."""
        cols, df = _list(cols), self.sample.data
        if (value is None) == (strategy is None):
            raise MethodError("give either value or strategy", where="fill_null")
        if strategy in ("zero", "one"):
            value = 0 if strategy == "zero" else 1
        if value is not None:
            out = df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(dict(df.dtypes)[c])) for c in cols})
        elif strategy in ("mean", "min", "max"):
            f = {"mean": F.avg, "min": F.min, "max": F.max}[strategy]
            one = df.agg(*[f(c).alias(f"__f_{c}") for c in cols])
            out = df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c), F.col(f"__f_{c}")) for c in cols}).drop(*[f"__f_{c}" for c in cols])
        elif strategy in ("forward", "backward"):
            out = _carried(df, cols, strategy == "forward")
        else:
            raise MethodError(f"no such strategy: {strategy}", param="strategy")
        return self.sample._with(out)

    # ---- rows --------------------------------------------------------------
    def filter_records(self, where=None, *, negate=False, check_singletons=False, on_singletons="ignore", inplace=False):
        p = predicate(where)
        if p is None:
            return self.sample
        out = self.sample._with(self.sample.data.where(~p if negate else p))
        if check_singletons and on_singletons != "ignore" and out.design.stratum and out.design.psu:
            if out.singleton.exists:
                if on_singletons == "error":
                    out.singleton.raise_error()
                out = out.warn("singletons", "filtering left strata with a single PSU")
        return out

    def order_by(self, cols, *, descending=False, nulls_last=True, inplace=False):
        cols = _list(cols)
        down = descending if isinstance(descending, list) else [descending] * len(cols)
        keys = [(F.col(c).desc_nulls_last() if nulls_last else F.col(c).desc_nulls_first()) if d else (F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first()) for c, d in zip(cols, down)]
        return self.sample._with(self.sample.data.orderBy(*keys))

    def distinct(self, cols=None, *, keep="first", maintain_order=True, inplace=False):
        """One row per key: first, last or any of them, or none of repeated ones."""
        df = self.sample.data
        keys = _list(cols) if cols is not None else df.columns
        if keep == "any" or (keep == "first" and cols is None):
            return self.sample._with(df.dropDuplicates(keys))
        marked = df.withColumn(INDEX, F.monotonically_increasing_id())
        if keep == "none":
            out = marked.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")
        elif keep in ("first", "last"):
            order = F.col(INDEX) if keep == "first" else F.col(INDEX).desc()
            out = marked.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
        else:
            raise MethodError(f"keep must be first, last, any or none, not {keep}", param="keep")
        return self.sample._with((out.orderBy(INDEX) if maintain_order else out).drop(INDEX))

    def with_row_index(self, name="row_index", offset=0, *, inplace=False):
        """Consecutive numbers: partition sizes first, then places within partitions."""
        df = self.sample.data.withColumns({"__p": F.spark_partition_id(), INDEX: F.monotonically_increasing_id()})
        counts = {r["__p"]: r["count"] for r in df.groupBy("__p").count().collect()}  # a number per partition
        start, at = [], offset
        for p in sorted(counts):
            start += [F.lit(p), F.lit(at)]
            at += counts[p]
        base = F.create_map(*start)[F.col("__p")] if start else F.lit(offset)
        out = df.withColumn(name, (base + F.col(INDEX).bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
        return self.sample._with(out.drop("__p", INDEX))

    # ---- expressions -------------------------------------------------------
    def mutate(self, specs: dict, *, inplace=False):
        """Add or replace columns.

        Values are expressions, columns, constants, lists of as many values as
        there are rows, or functions of a mapping from names to expressions.
        Specs of one call see each other: those that others use are computed first.
        """
        known = set(self.sample.data.columns) | set(specs)

        class Env(dict):
            def __missing__(self, k):
                if k not in known:
                    raise ColumnError(f"no such column: {k}", where="mutate")
                return col(k)

        made, arrays = {}, {}
        for k, v in specs.items():
            if callable(v) and not isinstance(v, (Expr, Column)):
                v = v(Env())
            if isinstance(v, (list, tuple)) or type(v).__module__ == "numpy":
                arrays[k] = list(v)
            else:
                made[k] = v
        uses = {k: (_names_in(v, set(specs)) - {k} if isinstance(v, Expr) else set()) for k, v in made.items()}
        out, left = self.sample.data, dict(made)
        if arrays:
            out = self._with_arrays(out, arrays)
        while left:
            layer = [k for k in left if not (uses[k] & set(left))]
            if not layer:
                raise MethodError(f"columns depend on each other in a circle: {', '.join(left)}", where="mutate")
            for k in layer:
                if isinstance(v := left[k], Expr) and v.length_changing:
                    raise MethodError(f"{k} changes the number of rows", where="mutate", hint=v.length_changing)
            out = compute(out, {k: left.pop(k) for k in layer})
        return self.sample._with(out)

    def _with_arrays(self, df, arrays: dict):
        import pandas as pd

        n = df.count()
        if bad := [k for k, v in arrays.items() if len(v) != n]:
            raise MethodError(f"{', '.join(bad)} must have {n} values", where="mutate")
        numbered = self.sample._with(df).wrangling.with_row_index(INDEX).data
        table = df.sparkSession.createDataFrame(pd.DataFrame({INDEX: range(n), **arrays}))
        return numbered.drop(*arrays).join(table, INDEX).drop(INDEX)

    def apply_labels(self, labels: dict | None = None, categories: dict | None = None, *, strict=True, overwrite=True, inplace=False):
        meta, cols = self.sample.meta, self.sample.data.columns
        for k in [*(labels or {}), *(categories or {})]:
            if k not in cols and strict:
                raise LabelError(f"no such column: {k}", where="apply_labels")
        for k, v in (labels or {}).items():
            if k in cols and (overwrite or k not in meta.labels()):
                meta = meta.set_label(k, v)
        for k, v in (categories or {}).items():
            if k in cols and (overwrite or not meta.resolve_labels(k)):
                meta = meta.set_value_labels(k, v)
        return self.sample._with(_meta=meta)
