"""Stored members of ZIP archives, written and located without extraction, ZIP64 included."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF       # a field with this value has its true one in a ZIP64 record
DOS_DATE = 0x21                           # 1980-01-01, the least date of the format


class Member(NamedTuple):
    name: str
    method: int        # 0: stored
    size: int          # bytes in the archive
    header: int        # place of the local header


def pack(members: list[tuple[str, bytes]]) -> bytes:
    """An archive of stored members, with ZIP64 fields throughout."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode("utf-8"), zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out += [LOCAL, struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, DOS_DATE, crc, FULL32, FULL32, len(raw), len(extra)),
                raw, extra, data]
        extra64 = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += [CENTRAL, struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, DOS_DATE, crc, FULL32, FULL32,
                                         len(raw), len(extra64), 0, 0, 0, 0, FULL32), raw, extra64]
        at += 30 + len(raw) + len(extra) + len(data)
    directory = b"".join(central)
    n = len(members)
    end64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at)
    locator = LOCATOR64 + struct.pack("<IQI", 0, at + len(directory), 1)
    end = END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    return b"".join((*out, directory, end64, locator, end))


class ZipRanges:
    """Member places of an open random-access file (seek, read, size)."""

    def __init__(self, f):
        self.f, self.size = f, f.size()
        self.members = {m.name: m for m in self._directory()}

    def _at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        return self.f.read(n)

    def _end(self) -> tuple[int, int, int]:
        """(members, bytes of the directory, its place)."""
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self._at(tail_at, self.size - tail_at)
        k = tail.rfind(END)
        while k >= 0 and k + 22 + int.from_bytes(tail[k + 20:k + 22], "little") != len(tail):
            k = tail.rfind(END, 0, k)      # the mark can also stand in the comment
        if k < 0:
            raise ValueError("not a ZIP archive, or cut short")
        n, size, place = struct.unpack_from("<HII", tail, k + 10)
        if n == FULL16 or size == FULL32 or place == FULL32:
            mark, _, end64, _ = struct.unpack("<4sIQI", self._at(tail_at + k - 20, 20))
            if mark != LOCATOR64:
                return n, size, place
            record = self._at(end64, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            n, size, place = struct.unpack_from("<QQQ", record, 32)
        return n, size, place

    def _directory(self):
        n, size, place = self._end()
        data, at = self._at(place, size), 0
        for _ in range(n):
            if data[at:at + 4] != CENTRAL:
                raise ValueError("bad central directory")
            (_, _, flags, method, _, _, _, packed, whole, name, extra, comment, _, _, _, header) = struct.unpack_from(
                "<HHHHHHIIIHHHHHII", data, at + 4)
            raw = data[at + 46:at + 46 + name]
            fields = data[at + 46 + name:at + 46 + name + extra]
            while len(fields) >= 4:
                kind, length = struct.unpack_from("<HH", fields)
                if kind == 1:              # the 64-bit values of the full fields, in this order
                    values = iter(struct.unpack(f"<{length // 8}Q", fields[4:4 + length // 8 * 8]))
                    whole = next(values) if whole == FULL32 else whole
                    packed = next(values) if packed == FULL32 else packed
                    header = next(values) if header == FULL32 else header
                fields = fields[4 + length:]
            yield Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, header)
            at += 46 + name + extra + comment

    def start(self, name: str) -> int:
        """The place of a stored member's first byte."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        local = self._at(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        name_size, extra = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + name_size + extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        size = self.members[name].size
        length = size - offset if length is None else min(length, size - offset)
        return self._at(self.start(name) + offset, length)
