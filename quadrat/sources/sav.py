"""SPSS system files (.sav, .zsav) by their published layout: reading and writing."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field

from quadrat.errors import SourceError

SYSMIS = -1.7976931348623157e308
HIGHEST, LOWEST = 1.7976931348623157e308, -1.7976931348623155e308
#: Format codes of the dictionary.
FORMATS = {1: "A", 2: "AHEX", 3: "COMMA", 4: "DOLLAR", 5: "F", 6: "IB", 7: "PIBHEX", 8: "P", 9: "PIB", 10: "PK", 11: "RB", 12: "RBHEX", 15: "Z", 16: "N", 17: "E", 20: "DATE", 21: "TIME", 22: "DATETIME", 23: "ADATE", 24: "JDATE", 25: "DTIME", 26: "WKDAY", 27: "MONTH", 28: "MOYR", 29: "QYR", 30: "WKYR", 31: "PCT", 32: "DOT", 33: "CCA", 34: "CCB", 35: "CCC", 36: "CCD", 37: "CCE", 38: "EDATE", 39: "SDATE", 40: "MTIME", 41: "YMDHMS"}
CODES = {v: k for k, v in FORMATS.items()}


@dataclass
class Variable:
    name: str
    width: int = 0  # 0 is numeric, else bytes of text
    label: str | None = None
    format: tuple[str, int, int] = ("F", 8, 2)
    value_labels: dict = field(default_factory=dict)
    missing: tuple = ()
    missing_range: tuple | None = None
    slots: int = 1

    @property
    def format_text(self) -> str:
        n, w, d = self.format
        return f"{n}{w}.{d}" if d else f"{n}{w}"


@dataclass
class Sav:
    variables: list[Variable]
    rows: list[tuple]
    file_label: str = ""
    encoding: str = "utf-8"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, "<"

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise SourceError("the file ends early", where="read_sav")
        self.at += n
        return out

    def int(self) -> int:
        return struct.unpack(self.end + "i", self.take(4))[0]

    def double(self) -> float:
        return struct.unpack(self.end + "d", self.take(8))[0]


def parse(data: bytes, encoding: str | None = None, user_na: bool = False, n_max: int | None = None, rows_skip: int = 0) -> Sav:
    r = _Reader(data)
    magic = r.take(4)
    if magic not in (b"$FL2", b"$FL3"):
        raise SourceError("this is no SPSS system file", where="read_sav")
    r.take(60)
    layout = r.take(4)
    r.end = "<" if struct.unpack("<i", layout)[0] in (2, 3) else ">"
    r.int()
    compression, _, n_cases, bias = r.int(), r.int(), r.int(), r.double()
    r.take(17)
    file_label = r.take(64)
    r.take(3)
    slots: list[Variable | None] = []
    raw_labels: list[tuple[list[tuple[bytes, bytes]], list[int]]] = []
    long_names, very_long, charset, long_labels = {}, {}, None, b""
    while True:
        kind = r.int()
        if kind == 2:
            width, has_label, n_missing = r.int(), r.int(), r.int()
            code = r.int()
            r.int()
            name = r.take(8)
            label = None
            if has_label:
                n = r.int()
                label = r.take((n + 3) // 4 * 4)[:n]
            values = [r.take(8) for _ in range(abs(n_missing))]
            if width == -1:
                slots.append(None)
                continue
            v = Variable(name.decode("latin-1").strip(), width, label, (FORMATS.get(code >> 16 & 255, "F"), code >> 8 & 255, code & 255))
            v.missing = (n_missing, values)
            slots.append(v)
        elif kind == 3:
            pairs = []
            for _ in range(r.int()):
                value = r.take(8)
                n = r.take(1)[0]
                pairs.append((value, r.take((n + 8) // 8 * 8 - 1)[:n]))
            if r.int() != 4:
                raise SourceError("value labels without variables", where="read_sav")
            raw_labels.append((pairs, [r.int() for _ in range(r.int())]))
        elif kind == 6:
            r.take(80 * r.int())
        elif kind == 7:
            sub, size, count = r.int(), r.int(), r.int()
            body = r.take(size * count)
            if sub == 13:
                long_names = dict(x.split(b"=", 1) for x in body.split(b"\t") if b"=" in x)
            elif sub == 14:
                very_long = {k: int(v.strip(b"\0\t ") or 0) for k, v in (x.split(b"=", 1) for x in body.replace(b"\0\t", b"\t").split(b"\t") if b"=" in x)}
            elif sub == 20:
                charset = body.decode("ascii", "ignore")
            elif sub == 21:
                long_labels = body
        elif kind == 999:
            r.int()
            break
        else:
            raise SourceError(f"unknown record {kind}", where="read_sav")
    enc = encoding or charset or "cp1252"
    text = lambda b: b.decode(enc, "replace")
    number = lambda b: struct.unpack(r.end + "d", b)[0]
    for pairs, at in raw_labels:
        for k in at:
            v = slots[k - 1]
            v.value_labels = {(number(b) if v.width == 0 else text(b[: v.width]).rstrip()): text(x) for b, x in pairs}
    for k, v in enumerate(slots):
        if v is None:
            continue
        v.label = text(v.label) if v.label is not None else None
        n, values = v.missing
        decoded = [number(b) if v.width == 0 else text(b).rstrip() for b in values]
        v.missing = tuple(decoded) if n >= 0 else tuple(decoded[2:])
        v.missing_range = (decoded[0], decoded[1]) if n < 0 else None
        v.slots = max(1, (v.width + 7) // 8)
    # texts over 255 bytes lie in several variables of 252 kept bytes each
    variables, k, gathered = [], 0, []
    order = [v for v in slots if v is not None]
    while k < len(order):
        v = order[k]
        size = very_long.get(v.name.encode("latin-1"), 0)
        n = max(1, (size + 251) // 252) if size > 255 else 1
        gathered.append((v, order[k : k + n], size))
        k += n
    for v, parts, size in gathered:
        if size:
            v.width = size
        v.name = text(long_names.get(v.name.encode("latin-1"), v.name.encode("latin-1")))
        variables.append(v)
    _read_long_labels(long_labels, variables, text, r.end)
    if compression == 0:
        cells = (r.data[i : i + 8] for i in range(r.at, len(r.data) - 7, 8))
    else:
        body = r.data[r.at :] if compression == 1 else _inflate(r)
        cells = _expand(body, bias, r.end)
    per_row = sum(x.slots for _, parts, _ in gathered for x in parts)
    rows, total = [], n_cases if n_cases >= 0 else math.inf
    n = 0
    while n < total and (n_max is None or len(rows) < n_max):
        one = [c for _, c in zip(range(per_row), cells)]
        if len(one) < per_row:
            break
        n += 1
        if n <= rows_skip:
            continue
        out, at = [], 0
        for v, parts, size in gathered:
            if v.width == 0:
                x = number(one[at])
                at += 1
                gone = x == SYSMIS or (not user_na and _is_missing(v, x))
                out.append(None if gone else x)
            else:
                pieces = []
                for p in parts:
                    b = b"".join(one[at : at + p.slots])
                    at += p.slots
                    pieces.append(b[:252] if len(parts) > 1 and p is not parts[-1] else b)
                s = text(b"".join(pieces)[: v.width].rstrip(b" "))
                out.append(None if not user_na and s in v.missing else s)
        rows.append(tuple(out))
    return Sav(variables, rows, text(file_label).strip(), enc)


def _read_long_labels(body: bytes, variables: list[Variable], text, end: str) -> None:
    by, at = {v.name: v for v in variables}, 0
    take = lambda n: struct.unpack(end + "i", body[n : n + 4])[0]
    while at + 4 <= len(body):
        n = take(at)
        name = text(body[at + 4 : at + 4 + n])
        at += 4 + n
        _, count = take(at), take(at + 4)
        at += 8
        for _ in range(count):
            n = take(at)
            value = text(body[at + 4 : at + 4 + n]).rstrip()
            at += 4 + n
            n = take(at)
            label = text(body[at + 4 : at + 4 + n])
            at += 4 + n
            if name in by:
                by[name].value_labels[value] = label


def _is_missing(v: Variable, x: float) -> bool:
    return x in v.missing or (v.missing_range is not None and v.missing_range[0] <= x <= v.missing_range[1])


def _inflate(r: _Reader) -> bytes:
    start, trailer, _ = struct.unpack(r.end + "qqq", r.take(24))
    n = struct.unpack(r.end + "i", r.data[trailer + 20 : trailer + 24])[0] if trailer + 24 <= len(r.data) else 0
    out = []
    for k in range(n):
        at = trailer + 24 + 24 * k
        _, packed_at, _, packed = struct.unpack(r.end + "qqii", r.data[at : at + 24])
        out.append(zlib.decompress(r.data[packed_at : packed_at + packed]))
    return b"".join(out)


def _expand(body: bytes, bias: float, end: str):
    """Cells of eight bytes from the command bytes of compressed data."""
    at = 0
    while at + 8 <= len(body):
        commands = body[at : at + 8]
        at += 8
        for c in commands:
            if c == 0:
                continue
            if c == 252:
                return
            if c == 253:
                yield body[at : at + 8]
                at += 8
            elif c == 254:
                yield b" " * 8
            elif c == 255:
                yield struct.pack(end + "d", SYSMIS)
            else:
                yield struct.pack(end + "d", c - bias)


def build(sav: Sav, compress: bool | str = True) -> bytes:
    """The bytes of a system file; ``compress`` may be False, True (byte codes) or "zlib"."""
    enc = "utf-8"
    raw = lambda s: s.encode(enc)
    short, used = {}, set()
    for k, v in enumerate(sav.variables):
        base = "".join(c for c in v.name.upper() if c.isalnum() and c.isascii())[:8] or "V"
        if not base[0].isalpha():
            base = "V" + base[:7]
        name = base
        while name in used:
            name = f"V{k:07d}"
        used.add(name)
        short[v.name] = name
    out, index, segments = [], 1, {}
    for v in sav.variables:
        n = (v.width + 251) // 252 if v.width > 255 else 1
        widths = [v.width] if n == 1 else [255] * (n - 1) + [v.width - 252 * (n - 1)]
        segments[v.name] = (index, widths)
        for k, w in enumerate(widths):
            name = short[v.name] if k == 0 else f"{short[v.name][:4]}{k:X}".ljust(5, "0")[:8]
            while k and name in used:
                name = f"S{len(used):07d}"
            used.add(name)
            kind, fw, fd = v.format if v.width == 0 else ("A", min(w, 255), 0)
            code = CODES.get(kind, 5) << 16 | fw << 8 | fd
            label = raw(v.label)[:255] if v.label and k == 0 else None
            miss = [] if v.width > 8 or k else list(v.missing)[:3]
            spec, n_miss = [], len(miss)
            if v.missing_range and v.width == 0:
                miss, n_miss = [*v.missing_range, *miss[:1]], -(2 + len(miss[:1]))
            spec = [struct.pack("<d", x) if v.width == 0 else raw(x).ljust(8)[:8] for x in miss]
            out.append(struct.pack("<6i", 2, w, int(label is not None), n_miss, code, code) + name.encode().ljust(8))
            if label is not None:
                out.append(struct.pack("<i", len(label)) + label.ljust((len(label) + 3) // 4 * 4))
            out += spec
            slots = max(1, (w + 7) // 8)
            out += [struct.pack("<6i", 2, -1, 0, 0, 0x011D01, 0x011D01) + b" " * 8] * (slots - 1)
            index += slots
    long_values = b""
    for v in sav.variables:
        if v.value_labels and v.width <= 8:
            part = struct.pack("<2i", 3, len(v.value_labels))
            for value, label in v.value_labels.items():
                x = raw(str(label))[:120]
                part += struct.pack("<d", float(value)) if v.width == 0 else raw(str(value)).ljust(8)[:8]
                part += bytes([len(x)]) + x.ljust((len(x) + 8) // 8 * 8 - 1)
            out.append(part + struct.pack("<3i", 4, 1, segments[v.name][0]))
        elif v.value_labels:
            name = raw(v.name)
            long_values += struct.pack("<i", len(name)) + name + struct.pack("<2i", v.width, len(v.value_labels))
            for value, label in v.value_labels.items():
                a, b = raw(str(value)).ljust(v.width), raw(str(label))
                long_values += struct.pack("<i", len(a)) + a + struct.pack("<i", len(b)) + b
    record = lambda sub, body, size=1: struct.pack("<4i", 7, sub, size, len(body) // size) + body
    out.append(record(3, struct.pack("<8i", 20, 0, 0, -1, 1, 1, 2, 65001), 4))
    out.append(record(4, struct.pack("<3d", SYSMIS, HIGHEST, LOWEST), 8))
    out.append(record(13, b"\t".join(short[v.name].encode() + b"=" + raw(v.name) for v in sav.variables)))
    if any(v.width > 255 for v in sav.variables):
        out.append(record(14, b"".join(f"{short[v.name]}={v.width:05d}\0\t".encode() for v in sav.variables if v.width > 255)))
    out.append(record(20, b"UTF-8"))
    if long_values:
        out.append(record(21, long_values))
    out.append(struct.pack("<2i", 999, 0))
    cells: list[tuple[int, bytes]] = []
    for row in sav.rows:
        for v, x in zip(sav.variables, row):
            if v.width == 0:
                if x is None or (isinstance(x, float) and math.isnan(x)):
                    cells.append((255, b""))
                elif float(x).is_integer() and -99 <= x <= 151:
                    cells.append((int(x) + 100, b""))
                else:
                    cells.append((253, struct.pack("<d", float(x))))
                continue
            b = raw(x or "")[: v.width]
            for w in segments[v.name][1]:
                part, b = (b[:252], b[252:]) if w == 255 and v.width > 255 else (b[:w], b[w:])
                part = part.ljust(max(1, (w + 7) // 8) * 8)
                cells += [(254, b"") if part[i : i + 8] == b" " * 8 else (253, part[i : i + 8]) for i in range(0, len(part), 8)]
    mode = 2 if compress == "zlib" else 1 if compress else 0
    body = _packed(cells) if mode else b"".join(_plain(c) for c in cells)
    per_row = index - 1
    head = (b"$FL3" if mode == 2 else b"$FL2") + b"@(#) SPSS DATA FILE quadrat".ljust(60) + struct.pack("<5id", 2, per_row, mode, 0, len(sav.rows), 100.0)
    head += b"01 Jan 20" + b"00:00:00" + raw(sav.file_label)[:64].ljust(64) + b"\0\0\0"
    front = head + b"".join(out)
    if mode < 2:
        return front + body
    start = len(front)
    blocks = [body[i : i + 0x3FF000] for i in range(0, len(body), 0x3FF000)] or [b""]
    packed = [zlib.compress(b) for b in blocks]
    trailer = start + 24 + sum(map(len, packed))
    table, plain_at, packed_at = b"", start, start + 24
    for b, p in zip(blocks, packed):
        table += struct.pack("<qqii", plain_at, packed_at, len(b), len(p))
        plain_at += len(b)
        packed_at += len(p)
    return front + struct.pack("<3q", start, trailer, 24 + len(table)) + b"".join(packed) + struct.pack("<qqii", -100, 0, 0x3FF000, len(blocks)) + table


def _plain(cell: tuple[int, bytes]) -> bytes:
    c, b = cell
    return b or (struct.pack("<d", SYSMIS) if c == 255 else b" " * 8 if c == 254 else struct.pack("<d", c - 100.0))


def _packed(cells: list[tuple[int, bytes]]) -> bytes:
    out = []
    cells = [*cells, (252, b"")]
    for i in range(0, len(cells), 8):
        eight = cells[i : i + 8]
        out.append(bytes(c for c, _ in eight).ljust(8, b"\0") + b"".join(b for _, b in eight))
    return b"".join(out)
