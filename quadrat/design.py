"""Sampling designs: which columns play which part."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import ClassVar

from quadrat.errors import DimensionError, MethodError


def names(value: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """A role's columns; several columns make one composite key."""
    if value is None:
        return ()
    return (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class PopSize:
    """Columns with the number of PSUs in the stratum and of SSUs in the PSU."""

    psu: str
    ssu: str | None = None


@dataclass(frozen=True)
class RepWeights:
    """Replicate weights: columns ``prefix`` 1..n, or one array column named ``array``."""

    prefix: str
    n_reps: int
    df: int | None = None
    padding: int = 0
    rscales: tuple[float, ...] | None = None
    array: str | None = None
    kind: ClassVar[str] = ""

    @property
    def columns(self) -> list[str]:
        return [f"{self.prefix}{str(r).zfill(self.padding)}" for r in range(1, self.n_reps + 1)]

    def coefficients(self, fay: float = 0.0) -> list[float]:
        raise NotImplementedError

    def degrees(self) -> int:
        return self.df if self.df is not None else self.n_reps - 1


@dataclass(frozen=True)
class BootstrapWeights(RepWeights):
    kind: ClassVar[str] = "bootstrap"

    def coefficients(self, fay: float = 0.0) -> list[float]:
        return list(self.rscales or [1 / self.n_reps] * self.n_reps)


@dataclass(frozen=True)
class JackknifeWeights(RepWeights):
    paired: bool = False
    kind: ClassVar[str] = "jackknife"

    def coefficients(self, fay: float = 0.0) -> list[float]:
        return list(self.rscales or [1.0 if self.paired else (self.n_reps - 1) / self.n_reps] * self.n_reps)


@dataclass(frozen=True)
class BRRWeights(RepWeights):
    fay_coef: float = 0.0
    kind: ClassVar[str] = "brr"

    def coefficients(self, fay: float = 0.0) -> list[float]:
        f = fay or self.fay_coef
        return list(self.rscales or [1 / (self.n_reps * (1 - f) ** 2)] * self.n_reps)


@dataclass(frozen=True)
class SDRWeights(RepWeights):
    kind: ClassVar[str] = "sdr"

    def coefficients(self, fay: float = 0.0) -> list[float]:
        return list(self.rscales or [4 / self.n_reps] * self.n_reps)


ROLES = ("row_index", "stratum", "wgt", "prob", "hit", "mos", "psu", "ssu", "pop_size", "wr", "rep_wgts")


@dataclass(frozen=True)
class Design:
    """Roles of columns.  ``stratum``, ``psu`` and ``ssu`` may be composite."""

    row_index: str | None = None
    stratum: str | tuple[str, ...] | None = None
    wgt: str | None = None
    prob: str | None = None
    hit: str | None = None
    mos: str | None = None
    psu: str | tuple[str, ...] | None = None
    ssu: str | tuple[str, ...] | None = None
    pop_size: PopSize | str | None = None
    wr: bool = False
    rep_wgts: RepWeights | None = None

    def __post_init__(self) -> None:
        if isinstance(self.pop_size, str):
            object.__setattr__(self, "pop_size", PopSize(self.pop_size))
        for role in ("stratum", "psu", "ssu"):
            if isinstance(getattr(self, role), list):
                object.__setattr__(self, role, tuple(getattr(self, role)))
        if self.ssu and not self.psu:
            raise DimensionError("an SSU needs a PSU", param="ssu")

    strata = property(lambda self: names(self.stratum))
    psus = property(lambda self: names(self.psu))
    ssus = property(lambda self: names(self.ssu))

    @property
    def method(self) -> str:
        """``replication`` if only replicate weights describe the sampling, else ``taylor``."""
        return "replication" if self.rep_wgts and not (self.stratum or self.psu) else "taylor"

    def update(self, **changes) -> Design:
        """A design with the given roles changed."""
        if bad := set(changes) - set(ROLES):
            raise MethodError(f"no such role: {', '.join(sorted(bad))}", where="Design.update")
        return replace(self, **changes)

    def fill_missing(self, other: Design) -> Design:
        """Roles that are unset here are taken from ``other``."""
        return replace(self, **{r: getattr(other, r) for r in ROLES if getattr(self, r) in (None, False)})

    def update_rep_weights(self, **changes) -> Design:
        if self.rep_wgts is None:
            raise MethodError("the design has no replicate weights", where="Design.update_rep_weights")
        return replace(self, rep_wgts=replace(self.rep_wgts, **changes))

    def specified_fields(self) -> list[str]:
        """Columns that any role names."""
        out = [c for c in (self.row_index, self.wgt, self.prob, self.hit, self.mos) if c]
        out += [*self.strata, *self.psus, *self.ssus]
        if self.pop_size:
            out += [c for c in (self.pop_size.psu, self.pop_size.ssu) if c]
        if self.rep_wgts:
            out += [self.rep_wgts.array] if self.rep_wgts.array else self.rep_wgts.columns
        return list(dict.fromkeys(out))

    def renamed(self, names_map: dict[str, str]) -> Design:
        """The design after columns were renamed."""
        new = lambda v: tuple(names_map.get(x, x) for x in v) if isinstance(v, tuple) else names_map.get(v, v)
        changes = {r: new(getattr(self, r)) for r in ("row_index", "stratum", "wgt", "prob", "hit", "mos", "psu", "ssu") if getattr(self, r)}
        if self.pop_size:
            changes["pop_size"] = PopSize(new(self.pop_size.psu), new(self.pop_size.ssu) if self.pop_size.ssu else None)
        if (rw := self.rep_wgts) and rw.array:
            changes["rep_wgts"] = replace(rw, array=new(rw.array))
        elif rw and any(c in names_map for c in rw.columns):
            first = names_map.get(rw.columns[0], rw.columns[0])
            stem = first[: len(first) - len(rw.columns[0]) + len(rw.prefix)]
            if [names_map.get(c, c) for c in rw.columns] != replace(rw, prefix=stem).columns:
                raise DimensionError("replicate weights must keep one prefix", where="rename_columns")
            changes["rep_wgts"] = replace(rw, prefix=stem)
        return replace(self, **changes)

    def show(self) -> str:
        return "\n".join(f"{r}: {getattr(self, r)}" for r in ROLES if getattr(self, r) not in (None, False))
