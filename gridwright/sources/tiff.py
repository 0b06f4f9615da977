"""TIFF and BigTIFF headers, and the data source `raster` over files of them.

    spark.dataSource.register(RasterSource)
    spark.read.format("raster").option("what", "ifds").load("/images")

what: ifds, tags, geokeys or blocks. Headers are read by ranges, so that none of the first three decodes a pixel, and
blocks reads only the byte ranges of the blocks that pushed filters on ifd_no, block_no, bx, by, x0 and y0 leave. Files
are listed and read through pyarrow's file systems: local paths, and any URI that they know.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridwright import schema
from gridwright.errors import InvalidHeader, RasterError, Unsupported

#: Rows of a batch; blocks of a partition; bytes of a file from which its blocks are dealt over tasks.
BATCH_ROWS, PARTITION_BLOCKS, LARGE = 256, 64, 4_000_000
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
SUFFIXES = (".tif", ".tiff")


class Bytes:
    """Ranges of a file; a cached head serves most header reads."""

    def __init__(self, stream, size: int, head: int = 65_536):
        self.stream, self.size = stream, size
        stream.seek(0)
        self.head = stream.read(min(head, size))

    def at(self, offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > self.size:
            raise RasterError(f"bytes {offset}..{offset + n} are outside the file of {self.size}")
        if offset + n <= len(self.head):
            return self.head[offset : offset + n]
        self.stream.seek(offset)
        return self.stream.read(n)


@dataclass
class Entry:
    """A tag: where its value lies, and the value. numbers: integers or floats; rationals as (numerator, denominator)."""

    tag: int
    field_type: int
    count: int
    value_offset: int
    raw: bytes = b""
    order: str = "<"

    @property
    def numbers(self) -> list:
        if self.field_type in (5, 10):
            kind = "I" if self.field_type == 5 else "i"
            flat = struct.unpack(f"{self.order}{2 * self.count}{kind}", self.raw)
            return list(zip(flat[::2], flat[1::2], strict=True))
        kind = CODES.get(self.field_type)
        return list(struct.unpack(f"{self.order}{self.count}{kind}", self.raw)) if kind else []

    @property
    def ints(self) -> list[int]:
        return [n for n in self.numbers if isinstance(n, int)]

    @property
    def doubles(self) -> list[float]:
        return [(n[0] / n[1] if n[1] else float("nan")) if isinstance(n, tuple) else float(n) for n in self.numbers]

    @property
    def text(self) -> str | None:
        return self.raw.rstrip(b"\0").decode("utf-8", "replace") if self.field_type == 2 else None


@dataclass
class Ifd:
    number: int
    offset: int
    big: bool
    order: str
    entries: list[Entry] = field(default_factory=list)
    #: What could not be read of this directory, or behind it.
    problem: str | None = None

    def get(self, tag: int) -> Entry | None:
        return next((e for e in reversed(self.entries) if e.tag == tag), None)

    def ints(self, tag: int, default: list[int] | None = None) -> list[int]:
        e = self.get(tag)
        return e.ints if e else (default or [])

    def one(self, tag: int, default: int | None = None) -> int | None:
        found = self.ints(tag)
        return found[0] if found else default

    def doubles(self, tag: int) -> list[float] | None:
        e = self.get(tag)
        return e.doubles if e else None

    def text(self, tag: int) -> str | None:
        e = self.get(tag)
        return e.text if e else None

    def geokeys(self) -> list[tuple[int, int, int, int, str]]:
        """(key, location, count, value or offset, value as text)."""
        directory = self.ints(34735)
        if not directory:
            return []
        if len(directory) < 4:
            raise RasterError("a GeoKey directory of fewer than 4 numbers")
        numbers, letters, found = self.doubles(34736) or [], self.text(34737) or "", []
        for k in range(min(directory[3], (len(directory) - 4) // 4)):
            key, location, count, value = directory[4 + 4 * k : 8 + 4 * k]
            if location == 0:
                text = str(value)
            elif location == 34736:
                text = str(numbers[value]) if value < len(numbers) else "Unknown"
            elif location == 34737:
                text = letters[value : value + count].rstrip("\0")
            else:
                text = "Unknown"
            found.append((key, location, count, value, text))
        return found

    def geokey(self, key: int) -> int | None:
        return next((v for k, location, _, v, _ in self.geokeys() if k == key and location == 0), None)


def read_ifds(source: Bytes, strict: bool = False, most: int | None = None, upto: int | None = None) -> list[Ifd]:
    """The chain of directories; offsets met before end it, so loops do no harm. A broken file header raises. A broken
    directory, one left out because `most` of them were read, and values outside the file are told in `problem`, or
    raise if strict. upto: the last directory that is wanted; nothing behind it is read."""
    if source.size < 8:
        raise InvalidHeader("too short for a header")
    order = {b"II": "<", b"MM": ">"}.get(source.at(0, 2))
    if order is None:
        raise InvalidHeader("byte order is neither II nor MM")
    version = struct.unpack(order + "H", source.at(2, 2))[0]
    if version == 42:
        big, at = False, struct.unpack(order + "I", source.at(4, 4))[0]
    elif version == 43:
        width, zero, at = struct.unpack(order + "HHQ", source.at(4, 12))
        big = True
        if width != 8 or zero != 0:
            raise InvalidHeader("a BigTIFF header needs offsets of 8 bytes and a zero")
    else:
        raise InvalidHeader(f"version {version} is neither 42 nor 43")
    if not 8 <= at < source.size:
        raise InvalidHeader(f"the first directory, at {at}, is outside the file")
    found, seen, why = [], set(), None
    while at and at not in seen and (upto is None or len(found) <= upto):
        if most is not None and len(found) == most:
            why = f"directories after the first {most} are left out"
            break
        seen.add(at)
        try:
            ifd, at = _read_ifd(source, at, big, order, len(found), strict)
        except (RasterError, struct.error) as broken:
            why = f"directory {len(found)} at {at}: {broken}"
            break
        found.append(ifd)
    if why and (strict or not found):
        raise RasterError(why)
    if why:
        found[-1].problem = "; ".join(x for x in (found[-1].problem, why) if x)
    return found


def _read_ifd(source: Bytes, at: int, big: bool, order: str, number: int, strict: bool) -> tuple[Ifd, int]:
    head, size, room, wide = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    n = struct.unpack(order + ("Q" if big else "H"), source.at(at, head))[0]
    body = source.at(at + head, n * size)
    ifd = Ifd(number, at, big, order)
    lost = []
    for k in range(n):
        part = body[k * size : (k + 1) * size]
        tag, kind, count = struct.unpack(order + "HH" + wide, part[: 4 + room])
        inline, length = part[4 + room :], SIZES.get(kind, 1) * count
        offset = struct.unpack(order + wide, inline)[0]
        if length <= room:
            raw = inline[:length]
        else:
            try:
                raw = source.at(offset, length)
            except RasterError:
                if strict:
                    raise
                lost.append(tag)  # a value outside the file: the entry is no use
                continue
        ifd.entries.append(Entry(tag, kind, count, offset, raw, order))
    if lost:
        ifd.problem = f"values outside the file: tags {lost}"
    after = at + head + n * size
    following = struct.unpack(order + wide, source.at(after, room))[0] if after + room <= source.size else 0
    return ifd, following


@dataclass(frozen=True)
class Block:
    block_no: int
    bx: int
    by: int
    x0: int
    y0: int
    w: int
    h: int
    stride: int
    offset: int
    byte_count: int


def blocks_of(ifd: Ifd) -> list[Block]:
    """The strips or tiles of a directory that have both an offset and a length."""
    width, height = ifd.one(256), ifd.one(257)
    if not width or not height:
        raise RasterError("no width or height")
    if ifd.one(322) and ifd.one(323):
        tw, th = ifd.one(322), ifd.one(323)
        across, listed = -(-width // tw), zip(ifd.ints(324), ifd.ints(325), strict=False)
        return [Block(n, n % across, n // across, n % across * tw, n // across * th, min(tw, width - n % across * tw), min(th, height - n // across * th), tw, o, c) for n, (o, c) in enumerate(listed) if n // across * th < height]
    rows = min(ifd.one(278, height) or height, height)
    return [Block(n, 0, n, 0, n * rows, width, min(rows, height - n * rows), width, o, c) for n, (o, c) in enumerate(zip(ifd.ints(273), ifd.ints(279), strict=False)) if n * rows < height]


def check_layout(ifd: Ifd) -> None:
    """Pixels are read of one unsigned sample of 8 bits, without a floating-point predictor."""
    if ifd.ints(258, [8]) != [8] or ifd.one(277, 1) != 1 or ifd.one(339, 1) != 1:
        raise Unsupported(f"samples of {ifd.ints(258, [8])} bits, {ifd.one(277, 1)} for each pixel, format {ifd.one(339, 1)}")
    if ifd.one(317, 1) not in (1, 2):
        raise Unsupported(f"predictor {ifd.one(317, 1)}")


def ifd_row(path: str, ifd: Ifd) -> tuple:
    return (
        path, ifd.number, ifd.offset, ifd.big, ifd.order == "<", len(ifd.entries), ifd.one(256), ifd.one(257), ifd.ints(258, [8]), ifd.one(277, 1), ifd.one(259, 1), ifd.one(262, 1),
        ifd.one(317, 1), ifd.one(284, 1), ifd.one(339, 1), ifd.one(322), ifd.one(323), ifd.one(278), ifd.one(254, 0), ifd.doubles(33550), ifd.doubles(33922), ifd.geokey(3072),
        ifd.geokey(2048), ifd.geokey(3074), ifd.text(42113), ifd.text(42112), ifd.problem,
    )


def tag_rows(path: str, ifd: Ifd) -> Iterator[tuple]:
    small = lambda n: n if n < 2**63 else n - 2**64
    for seq, e in enumerate(ifd.entries):
        yield path, ifd.number, seq, e.tag, e.field_type, small(e.count), small(e.value_offset), [small(n) for n in e.ints], e.doubles, e.text


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if urlparse(path).scheme == "file":
            return pafs.LocalFileSystem(), urlparse(path).path
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the raster files at or below path, by their extension."""
    system, inner = opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        if not inner.lower().endswith(SUFFIXES):
            raise Unsupported(f"not a .tif or .tiff file: {path}")
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise RasterError(f"no such file: {path}")
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(SUFFIXES))


def load(path: str) -> list[Ifd]:
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        return read_ifds(Bytes(f, f.size()))


class Part(InputPartition):
    """Whole files, or the lo-th of hi shares of a file's blocks."""

    def __init__(self, files: list[tuple[str, int]], lo: int = 0, hi: int | None = None):
        super().__init__(None)
        self.files, self.lo, self.hi = files, lo, hi


PRUNED = ("ifd_no", "block_no", "bx", "by", "x0", "y0")
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
BY_NAME = {t.__name__: f for t, f in TESTS.items()}


class RasterReader(DataSourceReader):
    def __init__(self, kind: str, path: str, strict: bool, most: int | None = None):
        self.kind, self.path, self.strict, self.most, self.tests = kind, path, strict, most, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if self.kind == "blocks" and type(f) in TESTS and name in PRUNED:
                self.tests.append((name, type(f).__name__, f.value))
            yield f  # Spark checks again

    def partitions(self):
        """Files by their sizes alone: the driver opens none. A large file's blocks go to several tasks, in runs of
        equal length."""
        files = listed(self.path)
        if self.kind != "blocks":
            each = max(1, -(-len(files) // 1000))
            return [Part(files[i : i + each]) for i in range(0, len(files), each)]
        parts, few = [], []
        for path, size in files:
            if size < LARGE:
                few.append((path, size))
                if len(few) == 32:
                    parts.append(Part(few))
                    few = []
            else:
                shares = -(-size // LARGE)
                parts += [Part([(path, size)], share, shares) for share in range(shares)]
        return parts + ([Part(few)] if few else [])

    def _passes(self, **known) -> bool:
        return all(BY_NAME[kind](known[name], value) for name, kind, value in self.tests if name in known)

    def _blocks(self, path: str, source: Bytes, ifd: Ifd, part: Part) -> Iterator[tuple]:
        own = blocks_of(ifd)
        if part.hi:
            own = own[len(own) * part.lo // part.hi : len(own) * (part.lo + 1) // part.hi]
        for b in own:
            if not self._passes(ifd_no=ifd.number, block_no=b.block_no, bx=b.bx, by=b.by, x0=b.x0, y0=b.y0):
                continue
            data, error = None, None
            try:
                data = source.at(b.offset, b.byte_count)
            except RasterError as why:
                if self.strict:
                    raise
                error = f"{type(why).__name__}: {why}"
            yield path, ifd.number, b.block_no, b.bx, b.by, b.x0, b.y0, b.w, b.h, b.stride, ifd.one(259, 1), ifd.one(317, 1), b.offset, b.byte_count, data, error

    def _error(self, path: str, ifd_no: int | None, why: Exception) -> tuple:
        """The row that tells of a file or directory that could not be read."""
        columns = len(DDL[self.kind].split(", "))
        if self.kind == "blocks":  # of the main directory, where none is known, so that a filter on it keeps the row
            ifd_no = ifd_no or 0
        return path, ifd_no, *[None] * (columns - 3), f"{type(why).__name__}: {why}"

    def _rows(self, part: Part) -> Iterator[tuple]:
        told = self.kind in ("ifds", "blocks") and not part.lo  # of a file dealt in shares the first one tells
        last = [value for name, kind, value in self.tests if name == "ifd_no" and kind in ("EqualTo", "LessThanOrEqual")]
        for path, _ in part.files:
            system, inner = opened(path)
            number = None
            try:
                with system.open_input_file(inner) as f:
                    source = Bytes(f, f.size())
                    for ifd in read_ifds(source, self.strict, self.most, min(last) if last else None):
                        number = ifd.number
                        if self.kind == "ifds":
                            yield ifd_row(path, ifd)
                        elif self.kind == "tags":
                            yield from tag_rows(path, ifd)
                        elif self.kind == "geokeys":
                            yield from ((path, ifd.number, *k) for k in ifd.geokeys())
                        elif self._passes(ifd_no=ifd.number):
                            try:
                                check_layout(ifd)
                                yield from self._blocks(path, source, ifd, part)
                            except RasterError as why:
                                if self.strict:
                                    raise
                                if told:
                                    yield self._error(path, number, why)
            except (RasterError, struct.error) as why:
                if self.strict:
                    raise
                if told:
                    yield self._error(path, number, why)

    def read(self, partition):
        kinds = pa.schema(_arrow(self.kind))
        rows = []
        for row in self._rows(partition):
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield _batch(rows, kinds)
                rows = []
        if rows:
            yield _batch(rows, kinds)


DDL = {"ifds": schema.IFDS, "tags": schema.TAGS, "geokeys": schema.GEOKEYS, "blocks": schema.BLOCKS}
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _arrow(kind: str) -> list[tuple[str, pa.DataType]]:
    return [(c.split()[0], ARROW[c.split()[1]]) for c in DDL[kind].split(", ")]


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


class RasterSource(DataSource):
    """Options: what (ifds, tags, geokeys, blocks), path, mode (permissive or failfast), most_ifds (directories read of
    each file at most; none by default). In mode permissive, ifds and blocks have a row with an error for each file or
    directory that is not read."""

    @classmethod
    def name(cls):
        return "raster"

    def schema(self):
        kind = self.options.get("what", "ifds")
        if kind not in DDL:
            raise Unsupported(f"what={kind!r} is none of {sorted(DDL)}")
        return DDL[kind]

    def reader(self, schema):
        most = self.options.get("most_ifds")
        return RasterReader(self.options.get("what", "ifds"), self.options["path"], self.options.get("mode", "permissive") == "failfast", int(most) if most else None)
