"""Queries over real TIFF files: written into the shared folder from the table `events`, read by the data source."""

from __future__ import annotations

import itertools
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import codecs, names
from gridwright.operators import catalog
from gridwright.plans import folder
from gridwright.plans.engine import RasterEngine
from gridwright.queries import EVENTS, _packed, events, query
from gridwright.sources import tiff, writers

#: Lines of a file; strips and tiles.
LINES, STRIP, TILE = 8, 3, 16
#: The layouts of the files, by their number: byte order, BigTIFF, tiles, compression, predictor.
LAYOUTS = tuple((order, big, tiled, compression, 1 + (i % 3 == 1)) for i, (compression, tiled, big, order) in enumerate(itertools.product((1, 8, 14), (False, True), (False, True), "<>")))
KEYS = (1, 1, 0, 6, 1024, 0, 1, 1, 1025, 0, 1, 1, 1026, 34737, 5, 0, 2056, 0, 1, 7030, 2057, 34736, 1, 0, 3072, 0, 1, 3857)
FILE = "coalesce(try_cast(regexp_extract(path, '([0-9]+)[.]tif$', 1) as int), -1)"


def tiff_bytes(data, number: int, broken: bool = False) -> bytes:
    """Lines (h, w) as a file of the layout of this number, with georeference and a half-size second directory. broken:
    the last block of the main image is said to lie behind the file's end."""
    import io

    import numpy as np

    order, big, tiled, compression, predictor = LAYOUTS[number % len(LAYOUTS)]
    out = io.BytesIO()
    writer, codec = writers.TiffWriter(out, big, order), codecs.codec(compression)
    for level, own in enumerate((data, data[::2, ::2])):
        h, w = own.shape
        bh, bw = (TILE, TILE) if tiled else (STRIP, w)
        placed = []
        for y, x in itertools.product(range(0, h, bh), range(0, w, bw)):
            part = own[y : y + bh, x : x + bw]
            block = np.zeros((bh if tiled else len(part), bw), np.uint8)
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8)).astype(np.uint8)
            placed.append(writer.block(codec.encode(block.tobytes())))
        if broken and not level:
            placed[-1] = (2**31, placed[-1][1])
        wide = 16 if big else 4
        offsets, counts = (wide, [o for o, _ in placed]), (wide, [n for _, n in placed])
        tags = {254: (4, [level]), 256: (4, [w]), 257: (4, [h]), 258: (3, [8]), 259: (3, [compression]), 262: (3, [1]), 277: (3, [1]), 317: (3, [predictor]), 305: (2, f"file {number}"), 282: (5, [(72, 1)])}
        tags |= {322: (4, [TILE]), 323: (4, [TILE]), 324: offsets, 325: counts} if tiled else {278: (4, [STRIP]), 273: offsets, 279: counts}
        if not level:
            tags |= {33550: (12, [10.0, 10.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 1000.0 * number, 5000.0, 0.0]), 34735: (3, list(KEYS)), 34736: (12, [6378137.0]), 34737: (2, "made|"), 42113: (2, "17")}
        writer.directory(tags)
    return out.getvalue()


def written(spark: SparkSession, sf_dir: str, broken: bool = False) -> str:
    """Writes the pixels of `events` as files of LINES lines each, in all layouts by turns, and returns their folder.
    broken: every third file has a block outside the file, and a fourth kind is no raster at all."""
    import pyarrow as pa

    home = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridwright-")  # the latter only in tests
    home = f"{home.rstrip('/')}/files-{uuid.uuid4().hex}"

    def write(batches):
        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"], np.uint8).reshape(-1, 100)
                system, inner = tiff.opened(f"{home}/{r['block_no']}.tif")
                system.create_dir(posixpath.dirname(inner), recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(b"no raster" if broken and r["block_no"] % 4 == 3 else tiff_bytes(data, r["block_no"], broken and r["block_no"] % 3 == 1))
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    _packed(events(spark, sf_dir), LINES).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return home


def file_no(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.expr(FILE))


_FILES = f"(select y // {LINES} as file, max(y) % {LINES} + 1 as lines from {EVENTS} group by 1) f"


def _pick(at: int) -> str:
    """SQL of a layout's part for each file."""
    shown = [{"<": "true", ">": "false"}.get(x[at], str(x[at]).lower()) for x in LAYOUTS]
    return f"([{', '.join(shown)}])[file % {len(LAYOUTS)} + 1]"


@query(f"select x, y, v from {EVENTS}")
def file_pixels(spark, sf_dir):
    """Every pixel, from strips and tiles of both byte orders, classic and BigTIFF, all codecs and both predictors."""
    blocks = RasterEngine(spark).read(written(spark, sf_dir), "blocks").where("ifd_no = 0")
    found = file_no(codecs.to_pixels(blocks).where(f"y < {LINES}"))
    return found.select("x", (F.col("y") + F.col("file") * LINES).cast("int").alias("y"), "v")


@query(
    f"select cast(file as int) file, cast(k as int) ifd_no, cast(case when k = 0 then 100 else 50 end as bigint) width, cast(case when k = 0 then lines else (lines + 1) // 2 end as bigint) height, "
    f"{_pick(0)} little_endian, {_pick(1)} big_tiff, cast({_pick(3)} as int) compression, cast({_pick(4)} as int) predictor, cast(case when {_pick(2)} then {TILE} end as int) tile_w, "
    f"cast(k as int) subfile, cast(case when k = 0 then 3857 end as int) epsg, case when k = 0 then '17' end nodata, cast(null as varchar) error from {_FILES}, (values (0), (1)) t(k)"
)
def file_directories(spark, sf_dir):
    heads = file_no(RasterEngine(spark).read(written(spark, sf_dir)))
    return heads.select("file", "ifd_no", "width", "height", "little_endian", "big_tiff", "compression", "predictor", "tile_w", "subfile", "epsg", "nodata", "error")


@query(f"select cast(file as int) file, cast(k as int) ifd_no, text, denominators from (select file, k, concat('file ', file) text, cast(72.0 as double) denominators from {_FILES}, (values (0), (1)) t(k))")
def file_tags(spark, sf_dir):
    """Text and rational values, of the tags Software and XResolution."""
    tags = file_no(RasterEngine(spark).read(written(spark, sf_dir), "tags")).where("tag in (305, 282)")
    return tags.groupBy("file", "ifd_no").agg(F.max("text").alias("text"), F.max(F.get("doubles", F.lit(0))).alias("denominators"))


@query(
    f"select cast(file as int) file, key_id, name, shown from {_FILES}, (values (cast(1024 as int), 'GTModelTypeGeoKey', 'ModelTypeProjected'), (1025, 'GTRasterTypeGeoKey', 'RasterPixelIsArea'), (1026, 'GTCitationGeoKey', 'made|'), "
    "(2056, 'GeogEllipsoidGeoKey', 'Ellipse_WGS_84'), (2057, 'GeogSemiMajorAxisGeoKey', '6378137.0'), (3072, 'ProjectedCSTypeGeoKey', 'WGS 84 / Web Mercator (Google Maps, OpenStreetMap)')) k(key_id, name, shown)"
)
def file_geokeys(spark, sf_dir):
    keys = file_no(RasterEngine(spark).read(written(spark, sf_dir), "geokeys"))
    return keys.select("file", "key_id", names.geo_key_name(F.col("key_id")).alias("name"), names.geo_key_text(F.col("key_id"), F.col("location"), F.col("value_offset"), F.col("value")).alias("shown"))


@query(
    f"with b as (select file, lines, case when {_pick(2)} then {TILE} else 100 end bw, case when {_pick(2)} then {TILE} else {STRIP} end bh from {_FILES}), "
    "g as (select *, unnest(generate_series(0, (lines - 1) // bh)) \"by\" from b), h as (select *, unnest(generate_series(0, 99 // bw)) bx from g) "
    "select cast(file as int) file, cast(bx as int) bx, cast(\"by\" as int) \"by\", cast(least(bw, 100 - bx * bw) as int) w, cast(least(bh, lines - \"by\" * bh) as int) h from h where bx * bw < 50 and \"by\" * bh < 5"
)
def file_blocks_pruned(spark, sf_dir):
    """The blocks that begin in a corner of each image: the filters reach the source, which reads no other's bytes."""
    blocks = RasterEngine(spark).read(written(spark, sf_dir), "blocks").where("ifd_no = 0 and x0 < 50 and y0 < 5")
    return file_no(blocks).select("file", "bx", "by", "w", "h")


@query(
    f"with f as (select *, case when file % 4 = 3 then 'InvalidHeader' end error, case when {_pick(2)} then {TILE} else 100 end bw, case when {_pick(2)} then {TILE} else {STRIP} end bh from {_FILES}), "
    f"p as (select x, y % {LINES} y, v, file, lines, error, (file % 3 = 1) and x // bw = 99 // bw and y % {LINES} // bh = (lines - 1) // bh lost from {EVENTS} join f on y // {LINES} = file) "
    "select cast(file as int) file, any_value(error) error, cast(sum(case when error is null then case when lost then 0 else v end end) as bigint) total, cast(case when any_value(error) is null then count(*) else 0 end as bigint) n from p group by file"
)
def file_errors(spark, sf_dir):
    """Damaged files: a block outside the file is zeros, and what is no raster has a row with its error."""
    blocks = RasterEngine(spark).read(written(spark, sf_dir, broken=True), "blocks").where("ifd_no = 0")
    found = file_no(codecs.to_pixels(blocks, errors=True))
    whole = events(spark, sf_dir).select(F.floor(F.col("y") / LINES).cast("int").alias("file"), (F.col("y") % LINES).alias("y"), "x")
    read = found.where("error is null").join(whole, ["file", "y", "x"]).groupBy("file").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    failed = found.where("error is not null").select("file", F.split("error", ":")[0].alias("error"))
    return read.join(failed, "file", "full").select("file", "error", "total", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"select x, y, v, cast(14 as int) compression from {EVENTS}")
def file_converted(spark, sf_dir):
    """Every file written anew with zstd blocks, and read again."""
    engine = RasterEngine(spark)
    home = written(spark, sf_dir)
    folder.convert_compression(engine, home, home + "-zstd", "zstd").agg(F.count("error")).collect()
    blocks = engine.read(home + "-zstd", "blocks").where("ifd_no = 0")
    kinds = file_no(engine.read(home + "-zstd").where("ifd_no = 0")).select("file", "compression")
    found = file_no(codecs.to_pixels(blocks)).join(kinds, "file")
    return found.select("x", (F.col("y") + F.col("file") * LINES).cast("int").alias("y"), "v", "compression")


@query(f"select cast(file as int) file, cast(x as int) x, cast(y as int) y, v from (select y // {LINES} file, x - 20 x, y % {LINES} - 3 y, v from {EVENTS}) p where x between 0 and 29 and y between 0 and 3")
def file_crop(spark, sf_dir):
    """The same box on every file of the folder, in each file's own coordinates."""
    engine = RasterEngine(spark)
    home = written(spark, sf_dir)
    near = engine.read(home, "blocks").where("ifd_no = 0 and x0 < 50 and y0 < 7").withColumns({"rx": F.lit(20), "ry": F.lit(3), "rw": F.lit(30), "rh": F.lit(4)})
    return file_no(codecs.to_pixels(near)).select("file", "x", "y", "v")


@query(f"select cast(y // {LINES} as int) file, min(v) min_value, max(v) max_value, cast(null as varchar) error from {EVENTS} group by 1")
def file_stats(spark, sf_dir):
    return file_no(folder.stats(RasterEngine(spark), written(spark, sf_dir))).select("file", "min_value", "max_value", "error")


@query(f"select cast(file as int) file, cast(k as int) ifd_no, case when k = 0 then 'full resolution' else 'overview' end kind, case {_pick(3)} when 1 then 'None' when 8 then 'Adobe Deflate' else 'Zstandard' end compression_name from {_FILES}, (values (0), (1)) t(k)")
def file_summary(spark, sf_dir):
    """The analysis of every directory, main images and overviews."""
    found = file_no(catalog.summary(RasterEngine(spark).read(written(spark, sf_dir))))
    return found.select("file", "ifd_no", "kind", "compression_name")
