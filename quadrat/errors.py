"""Typed errors: what went wrong, where, for which parameter, and what may help."""

from __future__ import annotations


class QuadratError(Exception):
    """Base of all errors raised here."""

    code = "error"

    def __init__(self, message: str, *, where: str | None = None, param: str | None = None, hint: str | None = None):
        self.message, self.where, self.param, self.hint = message, where, param, hint
        super().__init__(self.text())

    def text(self) -> str:
        parts = [f"[{self.code}] {self.message}"]
        if self.where:
            parts.append(f"where: {self.where}")
        if self.param:
            parts.append(f"parameter: {self.param}")
        if self.hint:
            parts.append(f"hint: {self.hint}")
        return "; ".join(parts)

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "where": self.where, "param": self.param, "hint": self.hint}


class MethodError(QuadratError):
    code = "method"


class DimensionError(QuadratError):
    code = "dimension"


class ModelError(QuadratError):
    code = "model"


class SingletonError(QuadratError):
    code = "singleton"


class SourceError(QuadratError):
    code = "source"


class LabelError(QuadratError):
    code = "label"


class DatasetError(QuadratError):
    code = "dataset"


class SerializationError(QuadratError):
    code = "serialization"


class ColumnError(QuadratError):
    code = "column"


class MissingValueError(QuadratError):
    code = "missing"
