"""SPSS portable files (.por): text of 80-column lines with base-30 numbers."""

from __future__ import annotations

from quadrat.errors import SourceError
from quadrat.sources.sav import FORMATS, Sav, Variable

#: The portable character set from position 64 on: digits, letters, then marks.
_ORDER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz .<(+|&[]!$*);^-/"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRST"


class _Text:
    def __init__(self, data: bytes):
        lines = data.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        body = "".join(x.ljust(80)[:80] for x in lines if x or lines.index(x) < len(lines) - 1)
        table = body[200:456]
        if body[456:464] != "SPSSPORT":
            swap = {table[64 + k]: c for k, c in enumerate(_ORDER) if 64 + k < 256}
            body = body[:200] + "".join(swap.get(c, c) for c in body[200:])
            if body[456:464] != "SPSSPORT":
                raise SourceError("this is no SPSS portable file", where="read_por")
        self.body, self.at = body, 464

    def char(self) -> str:
        if self.at >= len(self.body):
            raise SourceError("the file ends early", where="read_por")
        c = self.body[self.at]
        self.at += 1
        return c

    def number(self) -> float | None:
        while self.body[self.at] == " ":
            self.at += 1
        if self.body[self.at] == "*":
            self.at += 2
            return None
        end = self.body.index("/", self.at)
        text, self.at = self.body[self.at : end], end + 1
        return from_base30(text)

    def integer(self) -> int:
        return int(self.number() or 0)

    def string(self) -> str:
        n = self.integer()
        out, self.at = self.body[self.at : self.at + n], self.at + n
        return out


def from_base30(text: str) -> float:
    sign = -1.0 if text.startswith("-") else 1.0
    text = text.lstrip("+-")
    power = 0
    for k, c in enumerate(text):
        if k and c in "+-":
            power = int(from_base30(text[k:]))
            text = text[:k]
            break
    whole, _, part = text.partition(".")
    out = 0.0
    for c in whole:
        out = out * 30 + _DIGITS.index(c)
    scale = 1.0
    for c in part:
        scale /= 30
        out += _DIGITS.index(c) * scale
    return sign * out * 30.0**power


def parse(data: bytes) -> Sav:
    t = _Text(data)
    t.char()
    t.string(), t.string()
    variables: list[Variable] = []
    by: dict[str, Variable] = {}
    while True:
        tag = t.char()
        if tag == "F":
            break
        if tag in "123":
            t.string()
        elif tag in "45":
            t.integer()
        elif tag == "6":
            t.string()
        elif tag == "7":
            width, name = t.integer(), t.string()
            kind, w, d = t.integer(), t.integer(), t.integer()
            t.integer(), t.integer(), t.integer()
            v = by[name] = Variable(name, width, format=(FORMATS.get(kind, "F"), w, d))
            variables.append(v)
        elif tag in "89AB":
            v = variables[-1]
            value = (lambda v=v: t.string() if v.width else t.number())
            if tag == "8":
                v.missing = (*v.missing, value())
            elif tag == "9":
                v.missing_range = (float("-inf"), value())
            elif tag == "A":
                v.missing_range = (value(), float("inf"))
            else:
                v.missing_range = (value(), value())
        elif tag == "C":
            variables[-1].label = t.string()
        elif tag == "D":
            names = [t.string() for _ in range(t.integer())]
            first = by[names[0]]
            labels = {}
            for _ in range(t.integer()):
                value = t.string().rstrip() if first.width else t.number()
                labels[value] = t.string()
            for n in names:
                by[n].value_labels = dict(labels)
        elif tag == "E":
            for _ in range(t.integer()):
                t.string()
        elif tag == " ":
            continue
        else:
            raise SourceError(f"unknown tag {tag}", where="read_por")
    rows = []
    while t.at < len(t.body):
        while t.at < len(t.body) and t.body[t.at] == " ":
            t.at += 1
        if t.at >= len(t.body) or t.body[t.at] == "Z":
            break
        row = []
        for v in variables:
            if v.width:
                s = t.string().rstrip()
                row.append(None if s in v.missing else s)
            else:
                x = t.number()
                low, high = v.missing_range or (None, None)
                gone = x is None or x in v.missing or (low is not None and low <= x <= high)
                row.append(None if gone else x)
        rows.append(tuple(row))
    return Sav(variables, rows)
