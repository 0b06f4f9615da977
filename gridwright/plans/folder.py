"""The same requests over folders of rasters: every step is spread over files and blocks, nothing is gathered."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.errors import RasterError
from gridwright.functions import codecs, geo
from gridwright.plans.engine import RasterEngine
from gridwright.sources import tiff, writers


def regions(engine: RasterEngine, folder: str, box: tuple[float, float, float, float], epsg: int | None) -> DataFrame:
    """path and the window (rx, ry, rw, rh) of a box on the main image of each file; files without one are left out."""
    heads = engine.read(folder, "ifds").where("ifd_no = 0 and width > 0 and height > 0")
    corners: tuple[Column, ...] = tuple(F.lit(float(v)) for v in box)
    found = geo.region(corners, F.lit(epsg).cast("int"), F.coalesce("epsg", "geographic"), *geo.geotransform(F.col("tiepoint"), F.col("scale")), F.col("width"), F.col("height"))
    return heads.select("path", *(c.alias(n) for n, c in zip(("rx", "ry", "rw", "rh"), found, strict=True)))


def crop(engine: RasterEngine, folder: str, box: tuple[float, float, float, float], epsg: int | None) -> DataFrame:
    """path, x, y, v, error of the box in every file, counted from each window's corner. Blocks outside are never decoded.
    A file whose main image can't be read has one row, without x, y and v, with its error."""
    windows = regions(engine, folder, box, epsg)
    blocks = engine.read(folder, "blocks").where("ifd_no = 0").join(windows, "path", "left")
    near = blocks.where("w is null or x0 < rx + rw and y0 < ry + rh and x0 + w > rx and y0 + h > ry")
    return codecs.to_pixels(near, engine.mode == "failfast", errors=True)


def stats(engine: RasterEngine, folder: str) -> DataFrame:
    """path, min_value, max_value, error of every file's main image; one that can't be read has an error and nulls."""
    cells = codecs.to_pixels(engine.read(folder, "blocks").where("ifd_no = 0"), engine.mode == "failfast", errors=True)
    return cells.groupBy("path").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.max("error").alias("error"))


class Measured:
    """A file that is written forward twice: first nowhere, to learn which bytes are changed afterwards and to what, then
    as a stream with these in place. So neither memory nor a local folder holds the file."""

    def __init__(self):
        self.out, self.end, self.at, self.patches = None, 0, 0, {}

    def again(self, out) -> None:
        self.out, self.end, self.at = out, 0, 0

    def seek(self, place: int, whence: int = 0) -> None:
        self.at = self.end + place if whence == 2 else place

    def write(self, data: bytes) -> None:
        if self.at < self.end:  # a patch: known by the second time
            self.patches[self.at] = bytes(data)
            return
        if self.out:
            done = bytearray(data)
            for place, patch in self.patches.items():
                if self.end <= place < self.end + len(done):
                    done[place - self.end : place - self.end + len(patch)] = patch
            self.out.write(bytes(done))
        self.end += len(data)
        self.at = self.end


def recompressed(source: tiff.Bytes, out, target: int) -> int:
    """Writes a file's directories with other block compression, block by block. Returns the bytes written."""
    ifds, codec = tiff.read_ifds(source), codecs.codec(target)
    if not ifds:
        raise RasterError("no directory")
    writer = writers.TiffWriter(out, ifds[0].big)
    for ifd in ifds:
        offsets, counts = (324, 325) if ifd.get(324) else (273, 279)
        listed = zip(ifd.ints(offsets), ifd.ints(counts), strict=True)
        found = [writer.block(codecs.convert(source.at(o, n), ifd.one(259, 1), target)) for o, n in listed]
        tags = {e.tag: writers.repacked(e) for e in ifd.entries if e.field_type in writers.KIND_SIZE}
        kind = 16 if ifd.big else 4
        writer.directory(tags | {259: (3, [codec.code]), offsets: (kind, [o for o, _ in found]), counts: (kind, [n for _, n in found])})
    return writer.at


def convert_compression(engine: RasterEngine, folder: str, output: str, compression: int | str) -> DataFrame:
    """Converts every file of folder into output, a folder that all executors share, one file a row of a task.

    Returns path, output, before, after (bytes) and error of each file. The result is written while it is computed: run
    it once, to the end. A task that is repeated writes its files again. Each block is compressed twice, as a stream of
    bytes can't be changed afterwards.
    """
    code = (codecs.codec_named(compression) if isinstance(compression, str) else codecs.codec(compression)).code
    strict = engine.mode == "failfast"

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                target = posixpath.join(output, posixpath.basename(path))
                system, inner = tiff.opened(path)
                try:
                    with system.open_input_file(inner) as f:
                        source, made = tiff.Bytes(f, f.size()), Measured()
                        recompressed(source, made, code)
                        to, place = tiff.opened(target)
                        to.create_dir(posixpath.dirname(place), recursive=True)
                        with to.open_output_stream(place) as out:
                            made.again(out)
                            after = recompressed(source, made, code)
                    rows.append((path, target, source.size, after, None))
                except Exception as why:
                    if strict:
                        raise
                    rows.append((path, None, None, None, f"{type(why).__name__}: {why}"))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["path", "output", "before", "after", "error"])

    files = engine.read(folder, "ifds").where("ifd_no = 0 or ifd_no is null").select("path")
    return files.mapInArrow(run, "path string, output string, before long, after long, error string")
