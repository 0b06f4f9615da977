"""Block codecs, and the Arrow-batched functions that use them."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gridwright import schema
from gridwright.errors import Unsupported

ZSTD_LEVEL = 3


@dataclass(frozen=True)
class Codec:
    code: int
    name: str
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes], bytes]


def _unzstd(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(data) if data else b""


def zstd(level: int = ZSTD_LEVEL) -> Codec:
    level = min(22, max(1, level))
    return Codec(14, "ZSTD", lambda d: zstandard.ZstdCompressor(level=level).compress(d) if d else b"", _unzstd)


CODECS = {1: Codec(1, "Uncompressed", bytes, bytes), 8: Codec(8, "Adobe Deflate", zlib.compress, zlib.decompress), 14: zstd()}
#: Other numbers of the same formats, for reading.
ALIASES = {32946: 8, 50000: 14}
#: The names by which a codec may be asked for.
NAMES = {"none": 1, "uncompressed": 1, "deflate": 8, "zip": 8, "adobe deflate": 8, "zstd": 14}


def codec(code: int) -> Codec:
    found = CODECS.get(ALIASES.get(code, code))
    if not found:
        raise Unsupported(f"compression {code}")
    return found


def codec_named(name: str) -> Codec:
    if name.strip().lower() not in NAMES:
        raise Unsupported(f"compression {name!r}")
    return CODECS[NAMES[name.strip().lower()]]


def convert(data: bytes, source: int, target: int) -> bytes:
    return codec(target).encode(codec(source).decode(data))


def undo_predictor(rows: np.ndarray) -> np.ndarray:
    """Running sums along each row, modulo 256."""
    return np.cumsum(rows, axis=1, dtype=np.uint8)


def decode_block(data: bytes | None, compression: int, predictor: int, stride: int, w: int, h: int, strict: bool = False) -> np.ndarray:
    """(h, w) bytes; zeros for what is missing or broken, unless strict."""
    out = np.zeros((h, stride), np.uint8)
    try:
        raw = codec(compression).decode(bytes(data)) if data is not None else b""
    except Exception:
        if strict:
            raise
        raw = b""
    flat = np.frombuffer(raw, np.uint8)[: h * stride]
    out.reshape(-1)[: len(flat)] = flat
    if predictor == 2 and len(flat):
        out = undo_predictor(out)
    return out[:, :w]


def to_pixels(blocks: DataFrame, strict: bool = False, window: tuple[int, int, int, int] | None = None, errors: bool = False) -> DataFrame:
    """blocks (of the source) -> path, x, y, v. window: x, y, width, height; rows outside are not even made. Blocks with
    columns rx, ry, rw and rh have each their own window, and are counted from its corner. errors: a column error more, and a row without x, y and v for
    each row that stands for a file or directory which could not be read; otherwise these have no pixels."""
    own = {"rx", "ry", "rw", "rh"} <= set(blocks.columns)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["w"] is None:
                    if errors:
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]], pa.string()), *(pa.nulls(1, pa.int32()) for _ in "xyv"), pa.array([r["error"]], pa.string())], names=["path", "x", "y", "v", "error"])
                    continue
                v = decode_block(r["data"], r["compression"], r["predictor"], r["stride"], r["w"], r["h"], strict)
                x0, y0 = r["x0"], r["y0"]
                box = (r["rx"], r["ry"], r["rw"], r["rh"]) if own else window
                if box is not None:
                    left, top = max(box[0] - x0, 0), max(box[1] - y0, 0)
                    v = v[top : max(box[1] + box[3] - y0, 0), left : max(box[0] + box[2] - x0, 0)]
                    x0, y0 = x0 + left, y0 + top
                if own:
                    x0, y0 = x0 - box[0], y0 - box[1]
                x, y = np.meshgrid(np.arange(x0, x0 + v.shape[1], dtype=np.int32), np.arange(y0, y0 + v.shape[0], dtype=np.int32))
                columns = [pa.array([r["path"]], pa.string()).take(pa.array(np.zeros(v.size, np.int32))), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(v.ravel().astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(v.size, pa.string())] * errors, names=["path", "x", "y", "v", *["error"] * errors])

    return blocks.mapInArrow(run, schema.PIXELS + ", error string" * errors)


def to_lines(blocks: DataFrame, strict: bool, window: tuple[int, int, int, int]) -> DataFrame:
    """y, x, piece (binary): each block's part of each line of the window, counted from the window's corner."""
    left, top, width, height = window

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["w"] is None:
                    continue
                v = decode_block(r["data"], r["compression"], r["predictor"], r["stride"], r["w"], r["h"], strict)
                x0, y0 = max(left, r["x0"]), max(top, r["y0"])
                v = v[y0 - r["y0"] : max(0, top + height - r["y0"]), x0 - r["x0"] : max(0, left + width - r["x0"])]
                columns = [pa.array(np.arange(y0 - top, y0 - top + len(v), dtype=np.int32)), pa.array(np.full(len(v), x0 - left, np.int32)), pa.array([line.tobytes() for line in v], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["y", "x", "piece"])

    return blocks.mapInArrow(run, "y int, x int, piece binary")


def transcode(blocks: DataFrame, target: int) -> DataFrame:
    """blocks with their data in another compression; a block that cannot be read keeps no data."""
    codec(target)
    names = blocks.columns

    def run(batches):
        for batch in batches:
            out = []
            for data, source in zip(batch.column("data").to_pylist(), batch.column("compression").to_pylist(), strict=True):
                try:
                    out.append(None if data is None else convert(data, source, target))
                except Exception:
                    out.append(None)
            columns = {n: batch.column(n) for n in names} | {"data": pa.array(out, pa.binary()), "compression": pa.array([target] * len(out), pa.int32()), "byte_count": pa.array([len(x or b"") for x in out], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return blocks.mapInArrow(run, blocks.schema)
