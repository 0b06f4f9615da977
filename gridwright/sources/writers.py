"""Single-file writers. They take rows or blocks in order, one at a time, so none holds an image in memory."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from typing import BinaryIO

from gridwright.errors import BadRequest, Unsupported
from gridwright.sources.tiff import CODES, Entry

KIND_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}


def pack(kind: int, values, order: str = "<") -> tuple[int, bytes]:
    """Count and bytes of a tag's values: bytes or text, numbers, or pairs for rationals."""
    if isinstance(values, str):
        values = values.encode() + b"\0"
    if isinstance(values, bytes):
        return len(values) // KIND_SIZE[kind], values
    if kind in (5, 10):
        return len(values), struct.pack(f"{order}{2 * len(values)}{'I' if kind == 5 else 'i'}", *(n for pair in values for n in pair))
    return len(values), struct.pack(f"{order}{len(values)}{CODES[kind]}", *values)


def repacked(e: Entry) -> tuple[int, object]:
    """A read entry as (type, values) for the writer."""
    return e.field_type, (e.raw if e.field_type in (1, 2, 6, 7) or e.field_type not in CODES and e.field_type not in (5, 10) else e.numbers)


class TiffWriter:
    """TIFF or BigTIFF: blocks as they come, each directory after its blocks, its entries sorted by tag. Blocks, values
    and directories start at multiples of 4 (8 in BigTIFF). order: "<" little-endian, ">" big-endian."""

    def __init__(self, out: BinaryIO, big: bool = False, order: str = "<"):
        self.out, self.big, self.order, self.at = out, big, order, 0
        mark = b"II" if order == "<" else b"MM"
        self._write(struct.pack(order + "2sHHHQ", mark, 43, 8, 0, 0) if big else struct.pack(order + "2sHI", mark, 42, 0))
        self.link = 8 if big else 4

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _align(self) -> None:
        self._write(bytes(-self.at % (8 if self.big else 4)))

    def block(self, data: bytes) -> tuple[int, int]:
        self._align()
        at = self.at
        if not self.big and at + len(data) >= 2**32:
            raise Unsupported("over 4 GB: ask for BigTIFF")
        self._write(data)
        return at, len(data)

    def directory(self, tags: dict[int, tuple[int, object]]) -> None:
        """tag -> (field type, values). Of a tag added twice the dictionary holds the last."""
        room, wide, rows = (8, "Q", []) if self.big else (4, "I", [])
        for tag, (kind, values) in sorted(tags.items()):
            count, raw = pack(kind, values, self.order)
            if len(raw) > room:
                self._align()
                at = self.at
                self._write(raw)
                raw = struct.pack(self.order + wide, at)
            rows.append(struct.pack(self.order + "HH" + wide, tag, kind, count) + raw.ljust(room, b"\0"))
        self._align()
        at = self.at
        self._write(struct.pack(self.order + ("Q" if self.big else "H"), len(rows)) + b"".join(rows))
        here = self.at
        self._write(bytes(room))
        self.out.seek(self.link)
        self.out.write(struct.pack(self.order + wide, at))
        self.out.seek(0, 2)
        self.link = here


def image_tags(width: int, height: int, samples: int, blocks: list[tuple[int, int]], rows_per_strip: int, compression: int = 1, alpha: bool = False) -> dict[int, tuple[int, object]]:
    """The tags of an 8-bit image in strips: grey (1 sample), RGB (3) or RGBA (4)."""
    wide = 16 if max([o + n for o, n in blocks] or [0]) >= 2**32 else 4
    tags = {
        256: (4, [width]), 257: (4, [height]), 258: (3, [8] * samples), 259: (3, [compression]), 262: (3, [1 if samples == 1 else 2]), 273: (wide, [o for o, _ in blocks]),
        277: (3, [samples]), 278: (4, [rows_per_strip]), 279: (wide, [n for _, n in blocks]), 284: (3, [1]), 339: (3, [1] * samples),
    }
    if samples == 1:
        tags |= {280: (3, [0]), 281: (3, [255])}
    return tags | ({338: (3, [2])} if alpha else {})


def palette_tag(table: list[tuple[int, int, int]]) -> tuple[int, object]:
    """The ColorMap tag of (r, g, b) in 16 bits: all reds, all greens, all blues."""
    return 3, [c[k] for k in range(3) for c in table]


def write_image(out: BinaryIO, rows: Iterable[bytes], width: int, height: int, samples: int, more: dict[int, tuple[int, object]] | None = None, encode=bytes, compression: int = 1, big: bool = False) -> None:
    """Rows of width * samples bytes, from the top. Strips hold about 256 KB."""
    writer, blocks, part, n = TiffWriter(out, big), [], [], 0
    each = max(1, min(height, 262_144 // max(1, width * samples)))
    for row in rows:
        if len(row) != width * samples:
            raise BadRequest(f"a row of {len(row)} bytes; {width * samples} are needed")
        part.append(row)
        n += 1
        if len(part) == each:
            blocks.append(writer.block(encode(b"".join(part))))
            part = []
    if part:
        blocks.append(writer.block(encode(b"".join(part))))
    if n != height:
        raise BadRequest(f"{n} rows; {height} are needed")
    writer.directory(image_tags(width, height, samples, blocks, each, compression, samples == 4) | (more or {}))


def write_png(out: BinaryIO, rows: Iterable[bytes], width: int, height: int, samples: int) -> None:
    def chunk(kind: bytes, data: bytes) -> None:
        out.write(struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)))

    out.write(b"\x89PNG\r\n\x1a\n")
    chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[samples], 0, 0, 0))
    packer = zlib.compressobj()
    for row in rows:
        if data := packer.compress(b"\0" + row):
            chunk(b"IDAT", data)
    chunk(b"IDAT", packer.flush())
    chunk(b"IEND", b"")


def write_csv(out: BinaryIO, rows: Iterable[bytes], width: int) -> None:
    out.write(",".join(["row/col", *map(str, range(width))]).encode() + b"\n")
    for y, row in enumerate(rows):
        out.write(",".join([str(y), *map(str, row)]).encode() + b"\n")


def write_json(out: BinaryIO, rows: Iterable[bytes], width: int, height: int) -> None:
    out.write(f'{{\n  "width": {width},\n  "height": {height},\n  "data": [\n'.encode())
    for y, row in enumerate(rows):
        out.write(f"    [{', '.join(map(str, row))}]{',' if y < height - 1 else ''}\n".encode())
    out.write(b"  ]\n}\n")


def write_npy(out: BinaryIO, rows: Iterable[bytes], width: int, height: int) -> None:
    text = f"{{'descr': '<u1', 'fortran_order': False, 'shape': ({height}, {width}), }}"
    text += " " * (-(len(text) + 11) % 64) + "\n"
    out.write(b"\x93NUMPY\x01\x00" + struct.pack("<H", len(text)) + text.encode())
    for row in rows:
        out.write(row)


ARRAY_FORMATS = ("csv", "json", "npy")


def write_array(out: BinaryIO, rows: Iterable[bytes], width: int, height: int, kind: str) -> None:
    kind = kind.lower()
    if kind == "csv":
        write_csv(out, rows, width)
    elif kind == "json":
        write_json(out, rows, width, height)
    elif kind == "npy":
        write_npy(out, rows, width, height)
    else:
        raise BadRequest(f"array format {kind!r} is none of {ARRAY_FORMATS}")
