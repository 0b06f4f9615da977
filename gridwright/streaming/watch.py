"""New raster files of a folder as a stream: their headers and pixels, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwright.functions import codecs
from gridwright.schema import FILES, IFDS, PIXELS


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the .tif and .tiff files that arrive in folder."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(folder)
    return stream.select(*(c.split()[0] for c in FILES.split(", ")))


def ifds(stream: DataFrame) -> DataFrame:
    """A row for each directory; a broken file has one with its error."""

    def run(batches):
        import io

        import pyarrow as pa

        from gridwright.errors import RasterError
        from gridwright.sources import tiff

        kinds = pa.schema(tiff._arrow("ifds"))
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [tiff.ifd_row(path, i) for i in tiff.read_ifds(tiff.Bytes(io.BytesIO(content), len(content)))]
                except RasterError as why:
                    rows.append((path, *[None] * 25, f"{type(why).__name__}: {why}"))
            if rows:
                yield tiff._batch(rows, kinds)

    return stream.mapInArrow(run, IFDS)


def pixels(stream: DataFrame) -> DataFrame:
    """path, x, y, v, error of each file's main image; a file that can't be read has one row, with its error."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        from gridwright.errors import RasterError
        from gridwright.sources import tiff

        names = ["path", "x", "y", "v", "error"]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    source = tiff.Bytes(io.BytesIO(content), len(content))
                    main = tiff.read_ifds(source)[:1]
                    for ifd in main:
                        tiff.check_layout(ifd)
                        for b in tiff.blocks_of(ifd):
                            v = codecs.decode_block(source.at(b.offset, b.byte_count), ifd.one(259, 1), ifd.one(317, 1), b.stride, b.w, b.h)
                            x, y = np.meshgrid(np.arange(b.x0, b.x0 + b.w, dtype=np.int32), np.arange(b.y0, b.y0 + b.h, dtype=np.int32))
                            yield pa.RecordBatch.from_arrays([pa.array([path] * v.size, pa.string()), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(v.ravel().astype(np.int32)), pa.nulls(v.size, pa.string())], names=names)
                except RasterError as why:
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), *(pa.nulls(1, pa.int32()) for _ in "xyv"), pa.array([f"{type(why).__name__}: {why}"])], names=names)

    return stream.mapInArrow(run, PIXELS + ", error string")
