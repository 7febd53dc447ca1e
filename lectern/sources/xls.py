"""Cells of binary spreadsheets: the compound file around the workbook, and its records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
# Fixed record numbers of the format.
_BOF, _EOF, _CONTINUE, _SST, _SHEET, _PASSWORD = 0x809, 0x0A, 0x3C, 0xFC, 0x85, 0x2F
_NUMBER, _RK, _MULRK, _LABEL, _LABELSST, _FORMULA, _STRING, _BOOLERR = 0x203, 0x27E, 0xBD, 0x204, 0xFD, 0x06, 0x207, 0x205
_LAST = 0xFFFFFFFA  # sector numbers from here on end a chain


def workbook_bytes(data: bytes) -> bytes:
    """The workbook's records, taken out of the compound file."""
    if not data.startswith(_MAGIC):
        if data[:2] == struct.pack("<H", _BOF):
            return data
        raise ValueError("not a binary workbook")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, first_dir, cutoff = (struct.unpack_from("<I", data, k)[0] for k in (44, 48, 56))
    first_mini, more = struct.unpack_from("<I", data, 60)[0], struct.unpack_from("<I", data, 68)[0]
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    ints = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    held = list(struct.unpack_from("<109I", data, 76))
    while more < _LAST and len(held) < len(data):
        part = ints(sector(more))
        held, more = held + part[:-1], part[-1]
    fat = [x for k in held[:n_fat] if k < _LAST for x in ints(sector(k))]

    def chain(k: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table) + 1):
            if k >= len(table):
                return
            yield k
            k = table[k]

    whole = lambda k: b"".join(map(sector, chain(k, fat)))
    entries = whole(first_dir)
    mini = ints(whole(first_mini)) if first_mini < _LAST else []
    root = b""
    for at in range(0, len(entries) - 127, 128):
        name = entries[at : at + max(0, struct.unpack_from("<H", entries, at + 64)[0] - 2)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<II", entries, at + 116)
        if entries[at + 66] == 5:
            root = whole(start)
        if entries[at + 66] == 2 and name in ("Workbook", "Book"):
            if length < cutoff:
                return b"".join(root[k * small : (k + 1) * small] for k in chain(start, mini))[:length]
            return whole(start)[:length]
    raise ValueError("no workbook in the file")


def records(stream: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


class _Parts:
    """A record and those that continue it, read as one; a string cut between them names its width again."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.k < len(self.parts):
            out += self.parts[self.k][self.at : self.at + n - len(out)]
            self.at += n
            if self.at >= len(self.parts[self.k]) and len(out) < n:
                self.k, self.at = self.k + 1, 0
        if len(out) < n:
            raise ValueError("a record ends too soon")
        self.at = min(self.at, len(self.parts[self.k]))
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while len(out) < n:
            left = len(self.parts[self.k]) - self.at
            if not left:
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
                continue
            m = min(n - len(out), left // (1 + wide))
            out += self.take(m * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "replace")
        self.take(4 * runs + extra)
        return out


def _rk(raw: int) -> float:
    x = float((raw - (1 << 32) if raw & 1 << 31 else raw) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))[0]
    return x / 100 if raw & 1 else x


def _text(data: bytes, at: int) -> str:
    n, flags = struct.unpack_from("<HB", data, at)
    return data[at + 3 : at + 3 + n * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def sheets(data: bytes) -> Iterator[tuple[str, list[list[object]]]]:
    """(name, rows) of each sheet; numbers and dates are floats, blanks empty strings, truths and errors whole numbers."""
    stream = workbook_bytes(data)
    places, shared = [], []
    parts: list[bytes] | None = None
    for kind, body in records(stream, 0):
        if kind == _PASSWORD:
            raise ValueError("the workbook is encrypted")
        if parts is not None and kind != _CONTINUE:
            held = _Parts([parts[0][8:], *parts[1:]])
            shared = [held.string() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
            parts = None
        if kind == _SHEET and body[5] == 0:
            n, wide = body[6], body[7] & 1
            places.append((body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1"), struct.unpack_from("<I", body)[0]))
        elif kind == _SST:
            parts = [body]
        elif kind == _CONTINUE and parts is not None:
            parts.append(body)
        elif kind == _EOF:
            break
    for name, start in places:
        cells: dict[tuple[int, int], object] = {}
        asked = None  # the formula whose text comes next
        for kind, body in records(stream, start):
            if kind == _EOF:
                break
            if kind == _STRING and asked is not None:
                cells[asked], asked = _text(body, 0), None
            if kind not in (_NUMBER, _RK, _MULRK, _LABEL, _LABELSST, _FORMULA, _BOOLERR):
                continue
            at = struct.unpack_from("<HH", body)
            if kind == _NUMBER:
                cells[at] = struct.unpack_from("<d", body, 6)[0]
            elif kind == _RK:
                cells[at] = _rk(struct.unpack_from("<I", body, 6)[0])
            elif kind == _MULRK:
                for k in range((len(body) - 6) // 6):
                    cells[at[0], at[1] + k] = _rk(struct.unpack_from("<I", body, 6 + 6 * k)[0])
            elif kind == _LABELSST:
                cells[at] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif kind == _LABEL:
                cells[at] = _text(body, 6)
            elif kind == _BOOLERR:
                cells[at] = body[6]
            elif body[12:14] != b"\xff\xff":
                cells[at] = struct.unpack_from("<d", body, 6)[0]
            elif body[6] == 0:
                asked = at
            elif body[6] in (1, 2):
                cells[at] = body[8]
        n_rows, n_cols = (max((x[k] for x in cells), default=-1) + 1 for k in (0, 1))
        yield name, [[cells.get((r, c), "") for c in range(n_cols)] for r in range(n_rows)]
