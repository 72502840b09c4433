"""A fluent expression over columns, compiled to Spark columns when a frame is known.

An expression is a recipe: given a :class:`Scope` it returns a ``Column``.  The
scope knows the frame's row order (physical order is a column here) and the
partition a window runs over.  Aggregates outside ``over`` become one aggregation
whose single row is joined back, never a window over one partition.  Values that
change places within a group move as rows, never as an array of the group.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.errors import MethodError

INDEX = "__row_index"


@dataclass
class Move:
    """Each row's ``value`` goes to the row of its group that is at ``place`` in the rows' order, from 1.

    Moves of one ``order`` and partition go to the same places; those of a
    ``layer`` need values that the layers before have moved.
    """

    partition: tuple[str, ...]
    order: tuple
    place: Column
    value: Column
    layer: int


@dataclass
class Scope:
    """What compiling an expression may need; ``scalars`` collects whole-frame aggregates, ``moves`` values that change places."""

    partition: tuple[str, ...] = ()
    in_agg: bool = False
    scalars: dict[str, Column] = field(default_factory=dict)
    uses_index: bool = False
    moves: dict[str, Move] = field(default_factory=dict)

    @property
    def index(self) -> Column:
        self.uses_index = True
        return F.col(INDEX)

    def aggregate(self, value: Column) -> Column:
        if self.in_agg:
            return value
        if self.partition:
            return value.over(Window.partitionBy(*self.partition))
        name = f"__scalar_{len(self.scalars)}"
        self.scalars[name] = value
        return F.col(name)

    def moved(self, expr: Expr, order: tuple, place: Callable[[Column], Column], value: Callable[[Column], Column] = lambda c: c) -> Column:
        """``value`` of ``expr`` where ``place`` of it, a number within the group, says."""
        known = len(self.moves)
        c = expr.build(self)
        layer = 1 + max([m.layer for m in list(self.moves.values())[known:]], default=-1)
        name = f"__moved_{len(self.moves)}"
        self.moves[name] = Move(self.partition, order, place(c), value(c), layer)
        return F.col(name)

    def at(self) -> Column:
        return F.row_number().over(self.ordered())

    def ordered(self):
        return Window.partitionBy(*self.partition).orderBy(self.index)

    def running(self):
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)


Recipe = Callable[[Scope], Column]


def _column(value: Any, s: Scope) -> Column:
    if isinstance(value, Expr):
        return value.build(s)
    return value if isinstance(value, Column) else F.lit(value)


def _java_dates(fmt: str) -> str:
    """A strftime pattern in the letters of Java's date patterns."""
    letters = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "f": "SSSSSS", "p": "a", "I": "hh"}
    out, k = "", 0
    while k < len(fmt):
        if fmt[k] == "%" and k + 1 < len(fmt):
            out += "'%'" if fmt[k + 1] == "%" else letters[fmt[k + 1]]
            k += 2
        else:
            out += f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]
            k += 1
    return out


class Expr:
    """An immutable expression; arithmetic, comparison and ``& | ~`` build new ones."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, build: Recipe, name: str = "literal", length_changing: str | None = None):
        self.build, self.name, self.length_changing = build, name, length_changing

    def __repr__(self) -> str:
        return f"Expr({self.name})"

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and ~")

    def column(self, scope: Scope | None = None) -> Column:
        """The Spark column under the expression's name."""
        return self.build(scope or Scope()).alias(self.name)

    # helpers
    def _map(self, f: Callable[[Column], Column]) -> Expr:
        return Expr(lambda s: f(self.build(s)), self.name)

    def _two(self, other: Any, f: Callable[[Column, Column], Column]) -> Expr:
        return Expr(lambda s: f(self.build(s), _column(other, s)), self.name)

    def _kept(self, f: Callable[[Column], Column]) -> Expr:
        """Null stays null where Spark's function would answer."""
        return self._map(lambda c: F.when(c.isNotNull(), f(c)))

    def _agg(self, f: Callable[[Column], Column]) -> Expr:
        return Expr(lambda s: s.aggregate(f(self.build(s))), self.name)

    # operators
    def __add__(self, o):
        return self._two(o, lambda a, b: a + b)

    def __radd__(self, o):
        return self._two(o, lambda a, b: b + a)

    def __sub__(self, o):
        return self._two(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._two(o, lambda a, b: b - a)

    def __mul__(self, o):
        return self._two(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return self._two(o, lambda a, b: b * a)

    def __truediv__(self, o):
        return self._two(o, _divide)

    def __rtruediv__(self, o):
        return self._two(o, lambda a, b: _divide(b, a))

    def __floordiv__(self, o):
        return self._two(o, lambda a, b: F.floor(_divide(a, b)).cast("double"))

    def __rfloordiv__(self, o):
        return self._two(o, lambda a, b: F.floor(_divide(b, a)).cast("double"))

    def __mod__(self, o):
        return self._two(o, _modulo)

    def __rmod__(self, o):
        return self._two(o, lambda a, b: _modulo(b, a))

    def __pow__(self, o):
        return self._two(o, F.pow)

    def __rpow__(self, o):
        return self._two(o, lambda a, b: F.pow(b, a))

    def __neg__(self):
        return self._map(lambda c: -c)

    def __lt__(self, o):
        return self._two(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._two(o, lambda a, b: a <= b)

    def __gt__(self, o):
        return self._two(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._two(o, lambda a, b: a >= b)

    def __eq__(self, o):  # type: ignore[override]
        return self._two(o, lambda a, b: a == b)

    def __ne__(self, o):  # type: ignore[override]
        return self._two(o, lambda a, b: a != b)

    def __and__(self, o):
        return self._two(o, lambda a, b: a & b)

    def __rand__(self, o):
        return self._two(o, lambda a, b: b & a)

    def __or__(self, o):
        return self._two(o, lambda a, b: a | b)

    def __ror__(self, o):
        return self._two(o, lambda a, b: b | a)

    def __xor__(self, o):
        return self._two(o, lambda a, b: a != b)

    def __invert__(self):
        return self._map(lambda c: ~c)

    # names
    def alias(self, name: str) -> Expr:
        return Expr(self.build, name)

    def name_prefix(self, prefix: str) -> Expr:
        return self.alias(prefix + self.name)

    def name_suffix(self, suffix: str) -> Expr:
        return self.alias(self.name + suffix)

    # missing values
    def fill_null(self, value: Any) -> Expr:
        return self._two(value, F.coalesce)

    def fill_nan(self, value: Any) -> Expr:
        return self._two(value, lambda a, b: F.when(F.isnan(a), b).otherwise(a))

    def is_null(self) -> Expr:
        return self._map(lambda c: c.isNull())

    def is_not_null(self) -> Expr:
        return self._map(lambda c: c.isNotNull())

    def is_nan(self) -> Expr:
        return self._kept(F.isnan)

    def is_not_nan(self) -> Expr:
        return self._kept(lambda c: ~F.isnan(c))

    def is_finite(self) -> Expr:
        return self._kept(lambda c: ~F.isnan(c) & (F.abs(c) != float("inf")))

    def is_infinite(self) -> Expr:
        return self._kept(lambda c: F.abs(c) == float("inf"))

    def drop_nulls(self) -> Expr:
        return Expr(self.build, self.name, "drop_nulls")

    def drop_nans(self) -> Expr:
        return Expr(self.build, self.name, "drop_nans")

    # mathematics; logarithms of zero and below are -inf and NaN, not null
    def abs(self) -> Expr:
        return self._map(F.abs)

    def log(self, base: float | None = None) -> Expr:
        return self._map(lambda c: _log(c, F.log if base is None else lambda x: F.log(float(base), x)))

    def log10(self) -> Expr:
        return self._map(lambda c: _log(c, F.log10))

    def log2(self) -> Expr:
        return self._map(lambda c: _log(c, F.log2))

    def exp(self) -> Expr:
        return self._map(F.exp)

    def sqrt(self) -> Expr:
        return self._map(F.sqrt)

    def cbrt(self) -> Expr:
        return self._map(F.cbrt)

    def pow(self, exponent: Any) -> Expr:
        return self._two(exponent, F.pow)

    def round(self, decimals: int = 0) -> Expr:
        return self._map(lambda c: _rounded(c, decimals))

    def floor(self) -> Expr:
        return self._map(lambda c: F.floor(c).cast("double"))

    def ceil(self) -> Expr:
        return self._map(lambda c: F.ceil(c).cast("double"))

    def sign(self) -> Expr:
        return self._map(F.signum)

    def clip(self, lower: Any = None, upper: Any = None) -> Expr:
        def f(c: Column) -> Column:
            out = c if lower is None else F.greatest(c, F.lit(lower))
            return F.when(c.isNotNull(), out if upper is None else F.least(out, F.lit(upper)))

        return self._map(f)

    def sin(self) -> Expr:
        return self._map(F.sin)

    def cos(self) -> Expr:
        return self._map(F.cos)

    def tan(self) -> Expr:
        return self._map(F.tan)

    def arcsin(self) -> Expr:
        return self._map(F.asin)

    def arccos(self) -> Expr:
        return self._map(F.acos)

    def arctan(self) -> Expr:
        return self._map(F.atan)

    def radians(self) -> Expr:
        return self._map(F.radians)

    def degrees(self) -> Expr:
        return self._map(F.degrees)

    # types
    def cast(self, dtype: Any, strict: bool = True) -> Expr:
        return self._map(lambda c: c.cast(dtype) if strict else c.try_cast(dtype))

    def to_float(self) -> Expr:
        return self.cast("double")

    def to_int(self) -> Expr:
        return self.cast("bigint")

    def to_str(self) -> Expr:
        return self.cast("string")

    def to_bool(self) -> Expr:
        return self.cast("boolean")

    # membership
    def is_in(self, values: Iterable) -> Expr:
        return self._map(lambda c: c.isin(list(values)))

    def is_not_in(self, values: Iterable) -> Expr:
        return self._map(lambda c: ~c.isin(list(values)))

    def between(self, lower: Any, upper: Any, closed: str = "both") -> Expr:
        if closed not in ("both", "left", "right", "none"):
            raise MethodError("closed must be both, left, right or none", param="closed")

        def build(s: Scope) -> Column:
            c, lo, hi = self.build(s), _column(lower, s), _column(upper, s)
            return (c >= lo if closed in ("both", "left") else c > lo) & (c <= hi if closed in ("both", "right") else c < hi)

        return Expr(build, self.name)

    # aggregates
    def sum(self) -> Expr:
        return self._agg(F.sum)

    def mean(self) -> Expr:
        return self._agg(F.avg)

    def median(self) -> Expr:
        return self._agg(F.median)

    def mode(self) -> Expr:
        return self._agg(lambda c: F.mode(c, deterministic=True))

    def min(self) -> Expr:
        return self._agg(F.min)

    def max(self) -> Expr:
        return self._agg(F.max)

    def var(self, ddof: int = 1) -> Expr:
        if ddof in (0, 1):
            return self._agg(F.var_samp if ddof else F.var_pop)
        return self._agg(F.count)._two(self._agg(F.var_pop), lambda n, v: F.when(n > ddof, v * n / F.nullif(n - ddof, F.lit(0))))

    def std(self, ddof: int = 1) -> Expr:
        return self.var(ddof)._map(F.sqrt)

    def count(self) -> Expr:
        return self._agg(F.count)

    def len(self) -> Expr:
        return Expr(lambda s: s.aggregate(F.count(F.lit(1))), self.name)

    def null_count(self) -> Expr:
        return self._agg(lambda c: F.count_if(c.isNull()))

    def first(self) -> Expr:
        return Expr(lambda s: s.aggregate(F.min_by(self.build(s), s.index)), self.name)

    def last(self) -> Expr:
        return Expr(lambda s: s.aggregate(F.max_by(self.build(s), s.index)), self.name)

    def n_unique(self) -> Expr:
        """Distinct values; null is one of them."""
        return self._agg(lambda c: F.collect_set(F.struct(c)))._map(F.size)

    def unique(self) -> Expr:
        return self._agg(F.collect_set)

    def arg_min(self) -> Expr:
        return Expr(lambda s: s.aggregate(F.min_by(s.index, self.build(s))), self.name)

    def arg_max(self) -> Expr:
        return Expr(lambda s: s.aggregate(F.max_by(s.index, self.build(s))), self.name)

    def quantile(self, q: float, interpolation: str = "nearest") -> Expr:
        if interpolation == "linear":
            return self._agg(lambda c: F.percentile(c, F.lit(q)))

        def pick(values: Column) -> Column:
            v = F.sort_array(values)
            at = (F.size(v) - 1) * F.lit(float(q))
            low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
            return {"lower": low, "higher": high, "midpoint": (low + high) / 2, "nearest": F.get(v, F.round(at).cast("int"))}[interpolation]

        return self._agg(F.collect_list)._map(pick)

    def product(self) -> Expr:
        return self._agg(F.product)

    # windows
    def over(self, *partition_by: str | Expr) -> Expr:
        cols = tuple(p.name if isinstance(p, Expr) else p for p in partition_by)

        def build(s: Scope) -> Column:
            inner = Scope(cols, s.in_agg, s.scalars, moves=s.moves)
            out = self.build(inner)
            s.uses_index |= inner.uses_index
            return out

        return Expr(build, self.name)

    def _run(self, f: Callable[[Column], Column]) -> Expr:
        def build(s: Scope) -> Column:
            c = self.build(s)
            return F.when(c.isNotNull(), f(c).over(s.running()))

        return Expr(build, self.name)

    def cum_sum(self) -> Expr:
        return self._run(F.sum)

    def cum_prod(self) -> Expr:
        return self._run(F.product)

    def cum_min(self) -> Expr:
        return self._run(F.min)

    def cum_max(self) -> Expr:
        return self._run(F.max)

    def cum_count(self) -> Expr:
        return Expr(lambda s: F.count(self.build(s)).over(s.running()), self.name)

    def shift(self, n: int = 1, fill_value: Any = None) -> Expr:
        move = (lambda c: F.lag(c, n, fill_value)) if n >= 0 else (lambda c: F.lead(c, -n, fill_value))
        return Expr(lambda s: move(self.build(s)).over(s.ordered()), self.name)

    def diff(self, n: int = 1, null_behavior: str = "ignore") -> Expr:
        if null_behavior not in ("ignore", "drop"):
            raise MethodError("null_behavior must be ignore or drop", param="null_behavior")
        out = self - self.shift(n)
        return out if null_behavior == "ignore" else out.drop_nulls()

    def pct_change(self, n: int = 1) -> Expr:
        return self / self.shift(n) - 1

    def rank(self, method: str = "ordinal", descending: bool = False) -> Expr:
        def build(s: Scope) -> Column:
            c = self.build(s)
            parts = [F.col(p) for p in s.partition] + [c.isNull()]
            by = Window.partitionBy(*parts).orderBy(c.desc() if descending else c.asc())
            ties = F.count(F.lit(1)).over(Window.partitionBy(*parts, c))
            if method == "ordinal":
                out = F.row_number().over(Window.partitionBy(*parts).orderBy(c.desc() if descending else c.asc(), s.index))
            elif method == "dense":
                out = F.dense_rank().over(by)
            elif method in ("min", "max", "average"):
                low = F.rank().over(by)
                out = {"min": low, "max": low + ties - 1, "average": low + (ties - 1) / 2}[method]
            else:
                raise MethodError(f"no such rank method: {method}", param="method")
            return F.when(c.isNotNull(), out)

        return Expr(build, self.name)

    def _roll(self, f: Callable[[Column], Column], size: int) -> Expr:
        def build(s: Scope) -> Column:
            c, w = self.build(s), s.ordered().rowsBetween(-(size - 1), 0)
            return F.when(F.count(c).over(w) == size, f(c).over(w))

        return Expr(build, self.name)

    def rolling_mean(self, window_size: int) -> Expr:
        return self._roll(F.avg, window_size)

    def rolling_sum(self, window_size: int) -> Expr:
        return self._roll(F.sum, window_size)

    def rolling_std(self, window_size: int) -> Expr:
        return self._roll(F.stddev_samp, window_size)

    def rolling_min(self, window_size: int) -> Expr:
        return self._roll(F.min, window_size)

    def rolling_max(self, window_size: int) -> Expr:
        return self._roll(F.max, window_size)

    def ewm_mean(self, span: float | None = None, alpha: float | None = None) -> Expr:
        """Exponentially weighted mean with adjusted weights (1 - alpha) ** age.

        Both sums carry the weight from a fixed start, so each is a running sum.
        """
        if (span is None) == (alpha is None):
            raise MethodError("give either span or alpha", where="ewm_mean")
        a = alpha if alpha is not None else 2 / (span + 1)

        def build(s: Scope) -> Column:
            c = self.build(s)
            held = F.collect_list(F.struct(c.cast("double").alias("x"))).over(s.running())
            zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

            def step(acc: Column, x: Column) -> Column:
                v = x["x"]
                return F.struct((acc["n"] * (1 - a) + F.coalesce(v, F.lit(0.0))).alias("n"), (acc["d"] * (1 - a) + v.isNotNull().cast("double")).alias("d"))

            return F.aggregate(held, zero, step, lambda acc: F.try_divide(acc["n"], acc["d"]))

        return Expr(build, self.name)

    # strings
    def str_len(self) -> Expr:
        return self._map(F.char_length)

    def str_len_bytes(self) -> Expr:
        return self._map(F.octet_length)

    def lower(self) -> Expr:
        return self._map(F.lower)

    def upper(self) -> Expr:
        return self._map(F.upper)

    def title(self) -> Expr:
        return self._map(F.initcap)

    def strip(self, chars: str | None = None) -> Expr:
        return self._map(lambda c: F.btrim(c, F.lit(chars)) if chars is not None else F.regexp_replace(c, r"^\s+|\s+$", ""))

    def lstrip(self, chars: str | None = None) -> Expr:
        return self._map(lambda c: F.ltrim(c, F.lit(chars)) if chars is not None else F.regexp_replace(c, r"^\s+", ""))

    def rstrip(self, chars: str | None = None) -> Expr:
        return self._map(lambda c: F.rtrim(c, F.lit(chars)) if chars is not None else F.regexp_replace(c, r"\s+$", ""))

    def contains(self, pattern: str, literal: bool = False) -> Expr:
        return self._map(lambda c: c.contains(pattern) if literal else c.rlike(pattern))

    def startswith(self, prefix: str) -> Expr:
        return self._map(lambda c: c.startswith(prefix))

    def endswith(self, suffix: str) -> Expr:
        return self._map(lambda c: c.endswith(suffix))

    def replace(self, pattern: str, replacement: str, literal: bool = False) -> Expr:
        """The first match only: what stands before it is matched and kept."""
        p = _quoted(pattern) if literal else pattern
        r = re.sub(r"([\\$])", r"\\\1", replacement) if literal else _shifted(replacement)
        return self._map(lambda c: F.regexp_replace(c, rf"(?s)\A(.*?)(?:{p})", f"$1{r}"))

    def replace_all(self, pattern: str, replacement: str, literal: bool = False) -> Expr:
        return self._map(lambda c: F.replace(c, F.lit(pattern), F.lit(replacement)) if literal else F.regexp_replace(c, pattern, replacement))

    def slice(self, offset: int, length: int | None = None) -> Expr:
        def f(c: Column) -> Column:
            n = F.char_length(c)
            start = F.lit(offset + 1) if offset >= 0 else F.greatest(n + offset, F.lit(0)) + 1
            return F.substr(c, start.cast("int"), n if length is None else F.lit(length))

        return self._map(f)

    def head(self, n: int) -> Expr:
        return self._map(lambda c: F.substr(c, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.char_length(c) + n, F.lit(0))))

    def tail(self, n: int) -> Expr:
        return self._map(lambda c: F.right(c, F.lit(n)) if n >= 0 else F.substr(c, F.lit(1 - n), F.char_length(c)))

    def split(self, by: str) -> Expr:
        return self._map(lambda c: F.split(c, _quoted(by), -1))

    def concat(self, *others: Any, separator: str = "") -> Expr:
        return concat_str(self, *others, separator=separator).alias(self.name)

    def pad_left(self, length: int, fill_char: str = " ") -> Expr:
        return self._map(lambda c: F.when(F.char_length(c) < length, F.lpad(c, length, fill_char)).otherwise(c))

    def pad_right(self, length: int, fill_char: str = " ") -> Expr:
        return self._map(lambda c: F.when(F.char_length(c) < length, F.rpad(c, length, fill_char)).otherwise(c))

    def extract(self, pattern: str, group_index: int = 1) -> Expr:
        return self._map(lambda c: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group_index)))

    def count_matches(self, pattern: str, literal: bool = False) -> Expr:
        return self._map(lambda c: F.regexp_count(c, F.lit(_quoted(pattern) if literal else pattern)))

    # dates and times
    def dt_year(self) -> Expr:
        return self._map(F.year)

    def dt_month(self) -> Expr:
        return self._map(F.month)

    def dt_day(self) -> Expr:
        return self._map(F.dayofmonth)

    def dt_hour(self) -> Expr:
        return self._map(F.hour)

    def dt_minute(self) -> Expr:
        return self._map(F.minute)

    def dt_second(self) -> Expr:
        return self._map(F.second)

    def dt_weekday(self) -> Expr:
        """ISO day of the week, Monday 1 to Sunday 7."""
        return self._map(lambda c: F.weekday(c) + 1)

    def dt_week(self) -> Expr:
        return self._map(F.weekofyear)

    def dt_ordinal_day(self) -> Expr:
        return self._map(F.dayofyear)

    def dt_quarter(self) -> Expr:
        return self._map(F.quarter)

    def dt_date(self) -> Expr:
        return self._map(F.to_date)

    def dt_time(self) -> Expr:
        return self._map(lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"))

    def dt_epoch(self, unit: str = "s") -> Expr:
        f = {"s": F.unix_seconds, "ms": F.unix_millis, "us": F.unix_micros, "ns": lambda c: F.unix_micros(c) * 1000}[unit]
        return self._map(lambda c: f(c.cast("timestamp")))

    def dt_strftime(self, fmt: str) -> Expr:
        return self._map(lambda c: F.date_format(c, _java_dates(fmt)))

    def dt_truncate(self, every: str) -> Expr:
        """Truncate to a multiple of a unit: s, m, h, d, w (from the epoch), mo, q, y."""
        m = re.fullmatch(r"(\d+)(mo|[smhdwqy])", every)
        if not m or int(m[1]) < 1:
            raise MethodError(f"no such interval: {every}", param="every")
        n, unit = int(m[1]), m[2]
        if n == 1:
            name = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "q": "quarter", "y": "year"}[unit]
            return self._map(lambda c: F.date_trunc(name, c))
        if unit in ("mo", "q", "y"):
            size = n * {"mo": 1, "q": 3, "y": 12}[unit]
            month = lambda c: F.floor((F.year(c) * 12 + F.month(c) - 1) / size) * size
            return self._map(lambda c: F.make_date(F.floor(month(c) / 12).cast("int"), (month(c) % 12 + 1).cast("int"), F.lit(1)).cast("timestamp"))
        size = n * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[unit]
        shift = 259200 if unit == "w" else 0  # the epoch was a Thursday
        return self._map(lambda c: F.timestamp_seconds(F.floor((F.unix_seconds(c.cast("timestamp")) + shift) / size) * size - shift))

    # lists
    def list_len(self) -> Expr:
        return self._map(F.array_size)

    def list_get(self, index: int) -> Expr:
        return self._map(lambda c: F.get(c, F.lit(index)) if index >= 0 else F.try_element_at(c, F.lit(index)))

    def list_first(self) -> Expr:
        return self.list_get(0)

    def list_last(self) -> Expr:
        return self.list_get(-1)

    def list_sum(self) -> Expr:
        return self._map(lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))))

    def list_mean(self) -> Expr:
        return self._map(lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))), F.size(F.filter(c, lambda x: x.isNotNull()))))

    def list_min(self) -> Expr:
        return self._map(F.array_min)

    def list_max(self) -> Expr:
        return self._map(F.array_max)

    def list_contains(self, value: Any) -> Expr:
        return self._kept(lambda c: F.coalesce(F.array_contains(c, value), F.lit(False)))

    def list_join(self, separator: str) -> Expr:
        return self._map(lambda c: F.array_join(c, separator))

    def list_unique(self) -> Expr:
        return self._map(F.array_distinct)

    def list_sort(self, descending: bool = False) -> Expr:
        return self._map(lambda c: F.sort_array(c, not descending))

    def list_reverse(self) -> Expr:
        return self._map(F.reverse)

    def explode(self) -> Expr:
        return Expr(lambda s: F.explode_outer(self.build(s)), self.name, "explode")

    # whole columns, by position: each value moves to the row at its place in the new order
    def _sorted(self, descending: bool, nulls_last: bool, value: Callable[[Scope], Callable[[Column], Column]]) -> Expr:
        def place(s: Scope) -> Callable[[Column], Column]:
            name = f"{'desc' if descending else 'asc'}_nulls_{'last' if nulls_last else 'first'}"
            return lambda c: F.row_number().over(Window.partitionBy(*s.partition).orderBy(getattr(c, name)(), s.index))

        return Expr(lambda s: s.moved(self, (self.build, descending, nulls_last), place(s), value(s)), self.name)

    def sort(self, descending: bool = False, nulls_last: bool = False) -> Expr:
        return self._sorted(descending, nulls_last, lambda s: lambda c: c)

    def arg_sort(self, descending: bool = False, nulls_last: bool = False) -> Expr:
        """Positions within the group, from 0, in sorted order, each at its place; equal values in the rows' order."""
        return self._sorted(descending, nulls_last, lambda s: lambda c: (s.at() - 1).cast("bigint"))

    def reverse(self) -> Expr:
        def build(s: Scope) -> Column:
            count = F.count(F.lit(1)).over(Window.partitionBy(*s.partition))
            return s.moved(self, ("reverse",), lambda c: (count + 1 - s.at()).cast("int"))

        return Expr(build, self.name)

    def shuffle(self, seed: int | None = None) -> Expr:
        def build(s: Scope) -> Column:
            w = Window.partitionBy(*s.partition).orderBy(F.xxhash64(s.index, F.lit(seed or 0)), s.index)
            return s.moved(self, ("shuffle", seed or 0), lambda c: F.row_number().over(w))

        return Expr(build, self.name)

    def sample(self, n: int | None = None, fraction: float | None = None, seed: int | None = None) -> Expr:
        if (n is None) == (fraction is None):
            raise MethodError("give either n or fraction", where="sample")
        return Expr(self.build, self.name, f"sample:{n}:{fraction}:{seed or 0}")


def _divide(a: Column, b: Column) -> Column:
    """Division by zero gives an infinity or NaN, as floats do."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def _modulo(a: Column, b: Column) -> Column:
    """The remainder has the sign of the divisor."""
    return F.when(b != 0, a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double"))))


def _log(c: Column, f: Callable[[Column], Column]) -> Column:
    c = c.cast("double")
    return F.when(c == 0, float("-inf")).when(c < 0, float("nan")).otherwise(f(c))


def _rounded(c: Column, decimals: int) -> Column:
    """Round as SQL engines do floats: by the whole number nearest to the float ``c * 10 ** decimals``, half away from zero.

    Spark rounds the shortest decimal digits of ``c``, which falls on the other side where the
    product is rounded across the middle of two results.  The type of ``c`` stays.
    """

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return F.round(x * 10.0**decimals if decimals >= 0 else x / 10.0**-decimals)

    def one(x: Column) -> Column:
        near = F.round(x, decimals)
        return F.when(whole(x) == whole(near), near).otherwise(F.round(x - (near - x), decimals))

    return F.get(F.transform(F.array(c), one), 0)  # a variable, so that windows in c run once


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def _shifted(replacement: str) -> str:
    """Group numbers one up, as a group was put in front."""
    return re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)


# constructors
def col(name: str) -> Expr:
    return Expr(lambda s: F.col(f"`{name}`" if "." in name else name), name)


def cols(*names: str) -> list[Expr]:
    return [col(n) for n in names]


def lit(value: Any) -> Expr:
    return Expr(lambda s: F.lit(value))


class When:
    """``when(c).then(x).when(d).then(y).otherwise(z)``; without otherwise the rest is null."""

    def __init__(self, cases: list[tuple[Any, Any]], condition: Any):
        self.cases, self.condition = cases, condition

    def then(self, value: Any) -> Then:
        return Then([*self.cases, (self.condition, value)])


class Then(Expr):
    def __init__(self, cases: list[tuple[Any, Any]]):
        self.cases = cases
        first = cases[0][1]
        super().__init__(lambda s: self._case(s), first.name if isinstance(first, Expr) else "literal")

    def _case(self, s: Scope) -> Column:
        pairs = [(_column(c, s), _column(v, s)) for c, v in self.cases]
        return functools.reduce(lambda w, p: w.when(*p), pairs[1:], F.when(*pairs[0]))

    def when(self, condition: Any) -> When:
        return When(self.cases, condition)

    def otherwise(self, value: Any) -> Expr:
        return Expr(lambda s: self._case(s).otherwise(_column(value, s)), self.name)


def when(condition: Any) -> When:
    return When([], condition)


def _named(value: Any) -> Any:
    return col(value) if isinstance(value, str) else value


def _first_name(values: tuple) -> str:
    first = _named(values[0])
    return first.name if isinstance(first, Expr) else "literal"


def coalesce(*values: Any) -> Expr:
    return Expr(lambda s: F.coalesce(*[_column(_named(v), s) for v in values]), _first_name(values))


def concat_str(*values: Any, separator: str = "") -> Expr:
    """Null if any part is null."""

    def build(s: Scope) -> Column:
        parts: list[Column] = []
        for v in values:
            parts += ([F.lit(separator)] if parts and separator else []) + [_column(_named(v), s).cast("string")]
        return F.concat(*parts)

    return Expr(build, _first_name(values))


def _across(f: Callable[[Column, Column], Column], values: tuple, change: Callable[[Column], Column] = lambda c: c) -> Expr:
    return Expr(lambda s: functools.reduce(f, [change(_column(_named(v), s)) for v in values]), _first_name(values))


def all_horizontal(*values: Any) -> Expr:
    return _across(lambda a, b: a & b, values)


def any_horizontal(*values: Any) -> Expr:
    return _across(lambda a, b: a | b, values)


def sum_horizontal(*values: Any) -> Expr:
    return _across(lambda a, b: a + b, values, lambda c: F.coalesce(c, F.lit(0)))


def min_horizontal(*values: Any) -> Expr:
    return Expr(lambda s: F.least(*[_column(_named(v), s) for v in values]), _first_name(values))


def max_horizontal(*values: Any) -> Expr:
    return Expr(lambda s: F.greatest(*[_column(_named(v), s) for v in values]), _first_name(values))


def struct(**named: Any) -> Expr:
    return Expr(lambda s: F.struct(*[_column(_named(v), s).alias(k) for k, v in named.items()]), "struct")


def compute(df: DataFrame, exprs: dict[str, Expr | Column | Any]) -> DataFrame:
    """``df`` with the named expressions as columns, aggregates joined back as one row."""
    scope = Scope()
    built = {k: _column(v, scope) for k, v in exprs.items()}
    before = df.columns
    if scope.uses_index and INDEX not in df.columns:
        df = df.withColumn(INDEX, F.monotonically_increasing_id())
    if scope.scalars:
        # one row, whatever the frame's size
        df = df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in scope.scalars.items()])))
    for layer, partition in sorted({(m.layer, m.partition) for m in scope.moves.values()}):
        df = _moved(df, partition, {n: m for n, m in scope.moves.items() if (m.layer, m.partition) == (layer, partition)})
    out = df.withColumns(built)
    return out.select(*[f"`{c}`" for c in dict.fromkeys([*before, *built])])


def _moved(df: DataFrame, partition: tuple[str, ...], moves: dict[str, Move]) -> DataFrame:
    """``df`` with moved values as columns: a row is written for itself and for each order, and in order of places every row has its values right behind it.

    The places of an order are a permutation of the group's rows, so each place has
    one row of every copy.  One shuffle by the group serves all sorts.
    """
    orders: dict[tuple, Column] = {}
    for m in moves.values():
        orders.setdefault(m.order, m.place)
    here = F.row_number().over(Window.partitionBy(*partition).orderBy(INDEX))
    places = {f"__place_{k}": c for k, c in enumerate([here, *orders.values()])}
    df = df.withColumns(places | {f"__value{n}": m.value for n, m in moves.items()})
    copies = F.array(*[F.struct(F.col(p).alias("place"), F.lit(k).alias("copy")) for k, p in enumerate(places)])
    df = df.withColumn("__to", F.explode(copies)).drop(*places)
    w = Window.partitionBy(*partition).orderBy("__to.place", "__to.copy")
    behind = {o: k for k, o in enumerate(orders, 1)}
    df = df.withColumns({n: F.lead(f"__value{n}", behind[m.order]).over(w) for n, m in moves.items()})
    return df.where("__to.copy = 0").drop("__to", *[f"__value{n}" for n in moves])
