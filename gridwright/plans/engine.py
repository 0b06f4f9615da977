"""The façade: analysis, extraction, colormaps, arrays and compression of raster files.

Requests are planned on the driver from headers alone; pixels stay DataFrames, whose rows reach a single-file writer in
order and one partition at a time.
"""

from __future__ import annotations

import io
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.errors import BadRequest, MissingTag, Unsupported
from gridwright.functions import codecs, geo
from gridwright.functions import names as naming
from gridwright.operators import catalog, palette, pixels
from gridwright.sources import colormaps, tiff, writers

log = logging.getLogger("gridwright")
GEO = (33550, 33922, 34264, 34735, 34736, 34737)


@dataclass(frozen=True)
class Image:
    """A raster's main directory, and what a request needs of it."""

    path: str
    ifd: tiff.Ifd

    @property
    def width(self) -> int:
        return self.ifd.one(256)

    @property
    def height(self) -> int:
        return self.ifd.one(257)

    @property
    def epsg(self) -> int | None:
        """The projected system, or else the geographic one."""
        return self.ifd.geokey(3072) or self.ifd.geokey(2048)


class RasterEngine:
    def __init__(self, spark: SparkSession, mode: str = "permissive"):
        self.spark, self.mode = spark, mode
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(tiff.RasterSource)

    # --- relations

    def read(self, path: str, what: str = "ifds") -> DataFrame:
        return self.spark.read.format("raster").option("what", what).option("mode", self.mode).load(path)

    def pixels(self, path: str, window: tuple[int, int, int, int] | None = None, ifd_no: int = 0) -> DataFrame:
        """x, y, v of the window (x, y, width, height), counted from its corner, or of the whole image."""
        image = self.image(path, ifd_no)
        x, y, w, h = window or (0, 0, image.width, image.height)
        blocks = self._blocks(image, (x, y, w, h), ifd_no)
        return pixels.crop(codecs.to_pixels(blocks, self.mode == "failfast", (x, y, w, h)).select("x", "y", "v"), x, y, w, h)

    def _blocks(self, image: Image, window: tuple[int, int, int, int], ifd_no: int = 0) -> DataFrame:
        x, y, w, h = window
        pixels.check_window(x, y, w, h, image.width, image.height)
        tiff.check_layout(image.ifd)
        codecs.codec(image.ifd.one(259, 1))
        reach = max(image.ifd.one(322) or 0, image.ifd.one(323) or 0, image.width if not image.ifd.one(322) else 0, image.ifd.one(278, image.height) or 0)
        blocks = self.read(image.path, "blocks").where(f"ifd_no = {ifd_no} and x0 < {x + w} and y0 < {y + h} and x0 > {x - reach} and y0 > {y - reach}")
        return pixels.blocks_of_region(blocks, x, y, w, h)

    def _lines(self, image: Image, window: tuple[int, int, int, int]) -> Iterator[bytes]:
        """A window's lines from the top as they are: pieces of lines are exchanged, not pixels."""
        pieces = codecs.to_lines(self._blocks(image, window), self.mode == "failfast", window)
        whole = F.aggregate(F.array_sort(F.collect_list(F.struct("x", "piece"))), F.lit(b""), lambda line, p: F.concat(line, p["piece"]))
        for r in pieces.groupBy("y").agg(whole.alias("line")).orderBy("y").toLocalIterator():
            yield bytes(r["line"])

    def image(self, path: str, ifd_no: int = 0) -> Image:
        if not path.lower().endswith(tiff.SUFFIXES):
            raise Unsupported(f"not a .tif or .tiff file: {path}")
        ifds = tiff.load(path)
        if len(ifds) <= ifd_no:
            raise MissingTag("no directory")
        image = Image(path, ifds[ifd_no])
        if not image.width or not image.height:
            raise MissingTag("no width or height")
        return image

    # --- regions

    def resolve(self, image: Image, region=None, bbox: str | None = None, crs: str | int | None = None, coordinate: str | None = None, radius: float | None = None, strict: bool = False, on_outside: str = "center") -> tuple[int, int, int, int] | None:
        """The window that a request means: a region, else a coordinate with a radius, else a box; None for all.

        crs None: the box's numbers are pixels. strict: a box whose corners are out of order is taken as it is.
        on_outside: "raise" refuses a box in degrees that misses an image in EPSG 3857, "center" takes its middle.
        """
        if region is not None:
            return tuple(region)
        if radius is not None and coordinate is None:
            raise BadRequest("a radius needs a coordinate")
        one = self.spark.range(1)
        epsg = None if crs is None else one.select(geo.parse_crs(F.lit(str(crs))).alias("e")).first()["e"]
        known = F.lit(epsg).cast("int")
        if coordinate is not None and radius is not None:
            c = geo.parse_numbers(F.lit(coordinate), "x y")
            box = geo.radius_box(c["x"], c["y"], F.lit(float(radius)), F.coalesce(known, F.lit(0)))
        elif bbox is not None:
            b = geo.parse_numbers(F.lit(bbox), "x0 y0 x1 y1")
            box = tuple(b[n] for n in ("x0", "y0", "x1", "y1"))
        else:
            return None
        if not strict:
            box = (F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))
        numbers = lambda tag: F.array(*map(F.lit, image.ifd.doubles(tag) or [])).cast("array<double>")
        transform = geo.geotransform(numbers(33922), numbers(33550))
        size = F.lit(image.width).cast("long"), F.lit(image.height).cast("long")
        if on_outside == "raise" and epsg == 4326 and image.epsg == 3857:
            west, south = geo.box_mercator(box[0], box[1])
            east, north = geo.box_mercator(box[2], box[3])
            bounds = geo.raster_bounds(*transform, *size)
            if not one.select((west < bounds[2]) & (east >= bounds[0]) & (south < bounds[3]) & (north >= bounds[1])).first()[0]:
                raise BadRequest("the box misses the image")
        found = geo.region(box, known, F.lit(image.epsg).cast("int"), *transform, *size)
        return tuple(int(v) for v in one.select(*found).first())

    # --- rows for the writers

    @staticmethod
    def _rows(df: DataFrame, channels: tuple[str, ...]) -> Iterator[bytes]:
        """Lines from the top, one partition of them at a time on the driver."""
        packed = df.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", *channels))).alias("p")).select("y", F.transform("p", lambda p: F.array(*(p[c] for c in channels))).alias("p"))
        for r in packed.select("y", F.flatten("p").alias("p")).orderBy("y").toLocalIterator():
            yield bytes(r["p"])

    def _kept_tags(self, image: Image, window: tuple[int, int, int, int] | None, georeference: bool, proj: int | None = None) -> dict[int, tuple[int, object]]:
        """Tags that go along with a crop: text and others, NoData and metadata, and the shifted georeference."""
        skipped = {*catalog.LAYOUT_TAGS, *GEO, 34377, 338, 339, 254}
        more = {e.tag: writers.repacked(e) for e in image.ifd.entries if e.tag not in skipped and e.field_type in writers.KIND_SIZE}
        if not georeference:
            return more
        nodata = self.spark.range(1).select(naming_nodata(image.ifd.text(42113), image.ifd.text(42112))).first()
        more |= {42113: (2, nodata["n"][0]), 42112: (2, nodata["n"][1])}
        for tag in (34735, 34736, 34737):
            if e := image.ifd.get(tag):
                more[tag] = writers.repacked(e)
        if proj and 34735 in more:
            more[34735] = (3, with_epsg(image.ifd.ints(34735), proj))
        scale, tie = image.ifd.doubles(33550) or [], image.ifd.doubles(33922) or []
        if len(scale) >= 2 and len(tie) >= 6:
            x, y = (window or (0, 0))[:2]
            ox, oy = tie[3] - tie[0] * scale[0] + x * scale[0], tie[4] + tie[1] * scale[1] - y * abs(scale[1])
            more |= {33550: (12, [*scale, 0.0][:3]), 33922: (12, [0.0, 0.0, 0.0, ox, oy, 0.0])}
        elif window and (scale or tie):
            raise MissingTag("a crop needs two numbers of scale and six of a tie point")
        return more

    # --- requests

    def analyze(self, path: str) -> DataFrame:
        """A row for each directory."""
        return catalog.summary(self.read(path))

    def report(self, path: str) -> str:
        """The analysis as text."""
        lines = []
        for r in self.analyze(path).orderBy("path", "ifd_no").collect():
            lines += [f"{r['path']} directory {r['ifd_no']} ({r['kind']}) at {r['ifd_offset']}, {r['entry_count']} entries", f"  {r['width']} x {r['height']}, {r['samples']} samples, {r['photometric_name']}", f"  compression {r['compression']} ({r['compression_name']}), {'' if r['supported'] else 'not '}supported", f"  {r['projection']}"]
            lines += [f"  pixel scale {r['scale']}"] * bool(r["scale"]) + [f"  tie point {r['tiepoint']}"] * bool(r["tiepoint"])
        text = naming.geo_key_text(F.col("key_id"), F.col("location"), F.col("value_offset"), F.col("value"))
        for k in self.read(path, "geokeys").select(naming.geo_key_name(F.col("key_id")).alias("name"), text.alias("text")).collect():
            lines.append(f"  {k['name']}: {k['text']}")
        for t in catalog.first_tags(catalog.describe_tags(self.read(path, "tags")), by=("path", "ifd_no")).orderBy("path", "ifd_no", "rank").collect():
            lines.append(f"  {t['tag']} {t['tag_name']} {t['type_name']} x{t['count']}")
        return "\n".join(lines)

    def extract(self, path: str, output, *, region=None, bbox=None, crs=None, coordinate=None, radius=None, shape: str = "square", filter: str | None = None, filter_transparent: bool = False, colormap: str | None = None, proj: str | int | None = None, compression: int = 1, **how) -> None:
        """Writes the asked part of an image to a path or an open binary file.

        A plain square is a TIFF whatever the extension; a circle is a PNG with a transparent outside, without
        georeference; a filtered or coloured image is a PNG or a TIFF by the extension. Filter, colours and circle are
        applied in this order. proj rewrites the EPSG code and moves no pixel.
        """
        if shape not in ("square", "circle"):
            raise BadRequest(f"shape {shape!r}")
        image = self.image(path)
        window = self.resolve(image, region, bbox, crs, coordinate, radius, **how)
        x, y, w, h = window or (0, 0, image.width, image.height)
        df, channels = self.pixels(path, (x, y, w, h)), ("v",)
        if filter is not None:
            low, high = pixels.parse_range(filter)
            df, channels = (pixels.value_filter_alpha(df, low, high), ("r", "g", "b", "a")) if filter_transparent else (pixels.value_filter(df, low, high), ("v",))
        if colormap is not None:
            entries, kind = colormaps.read_colormap(self.spark, colormap)
            grey = pixels.rgb_to_grey(df) if "r" in df.columns else df
            df, channels = palette.apply_colormap(grey, entries, kind), ("r", "g", "b")
        if shape == "circle":
            df, channels = pixels.circle_mask(df if "r" in df.columns else pixels.grey_to_rgb(df), w, h), ("r", "g", "b", "a")
        named = isinstance(output, str)
        ending = output.rsplit(".", 1)[-1].lower() if named and "." in output else ""
        plain = filter is None and colormap is None and shape == "square"
        as_png = shape == "circle" and not (colormap and ending in ("tif", "tiff")) or not plain and ending not in ("tif", "tiff")
        if not plain and shape != "circle" and named and ending not in ("png", "tif", "tiff"):
            raise Unsupported(f"no writer for .{ending}")
        if as_png and named and ending != "png":
            output = (output.rsplit(".", 1)[0] if ending else output) + ".png"
        if not as_png and "a" in channels and colormap:
            channels = ("r", "g", "b")  # black corners
        epsg = None if proj is None else self.spark.range(1).select(geo.parse_crs(F.lit(str(proj)))).first()[0]
        more = {} if as_png else self._kept_tags(image, window, plain or colormap is not None and window is not None, epsg)
        codec = codecs.codec(compression)
        out = open(output, "wb") if named else output  # noqa: SIM115
        try:
            rows = self._lines(image, (x, y, w, h)) if plain else self._rows(df, channels)
            if as_png:
                writers.write_png(out, rows, w, h, {1: 1, 3: 3, 4: 4}[len(channels)])
            else:
                writers.write_image(out, rows, w, h, len(channels), more, codec.encode, codec.code, w * h * len(channels) >= 2**32 - 2**20)
        finally:
            if named:
                out.close()
        log.info("extracted %sx%s from %s", w, h, path)

    def extract_to_buffer(self, path: str, **request) -> bytes:
        out = io.BytesIO()
        self.extract(path, out, **request)
        return out.getvalue()

    def extract_with_colormap(self, path: str, output: str, colormap: str, **request) -> None:
        self.extract(path, output, colormap=colormap, **request)

    def extract_array_data(self, path: str, *, region=None, **request) -> DataFrame:
        """y and row (array) of the asked part."""
        return pixels.rows_of(self.pixels(path, self.resolve(self.image(path), region, **request)))

    def extract_to_array(self, path: str, output: str, kind: str = "csv", *, region=None, **request) -> None:
        if kind.lower() not in writers.ARRAY_FORMATS:
            raise BadRequest(f"array format {kind!r} is none of {writers.ARRAY_FORMATS}")
        image = self.image(path)
        x, y, w, h = self.resolve(image, region, **request) or (0, 0, image.width, image.height)
        with open(output, "wb") as out:
            writers.write_array(out, self._lines(image, (x, y, w, h)), w, h, kind)

    def extract_colormap(self, path: str, output: str, name: str = "raster") -> DataFrame:
        """Writes a palette, or any colormap file, as a style, and returns its entries."""
        entries, kind = colormaps.read_colormap(self.spark, path)
        with open(output, "w", encoding="utf-8") as out:
            out.write(colormaps.sld_text(entries, name, kind))
        return entries

    def save_palette(self, path: str, output: str, colormap: str, compression: int = 1) -> None:
        """Writes the image as a palette TIFF: its values are places in a ColorMap of 256 colours, made of the colormap's
        entries and the steps between them."""
        image = self.image(path)
        entries, _ = colormaps.read_colormap(self.spark, colormap)
        table = [(r["r"], r["g"], r["b"]) for r in palette.palette_table(entries.where("value between 0 and 255"), 256).orderBy("v").collect()]
        window, codec = (0, 0, image.width, image.height), codecs.codec(compression)
        more = self._kept_tags(image, None, True) | {262: (3, [3]), 320: writers.palette_tag(table)}
        with open(output, "wb") as out:
            writers.write_image(out, self._lines(image, window), image.width, image.height, 1, more, codec.encode, codec.code, image.width * image.height >= 2**32 - 2**20)

    def convert_compression(self, path: str, output: str, compression: int | str) -> None:
        """The same directories, tags and pixels with other block compression; little-endian, classic or Big as before."""
        codec = codecs.codec_named(compression) if isinstance(compression, str) else codecs.codec(compression)
        ifds = tiff.load(path)
        if not ifds:
            raise MissingTag("no directory")
        for ifd in ifds:
            codecs.codec(ifd.one(259, 1))
            wide = max(ifd.ints(258, [8]))
            if ifd.order == ">" and wide > 8 and ifd.one(317, 1) != 3:
                raise Unsupported("samples of several bytes in a big-endian file")
        blocks = self.spark.createDataFrame([(i.number, n, i.one(259, 1), o, c) for i in ifds for n, (o, c) in enumerate(zip(i.ints(324) or i.ints(273), i.ints(325) or i.ints(279), strict=True))], "ifd_no int, block_no int, compression int, offset long, byte_count long")
        done = transcoded(blocks, path, codec.code).orderBy("ifd_no", "block_no").toLocalIterator()
        with open(output, "wb") as out:
            writer, at = writers.TiffWriter(out, ifds[0].big), next(done, None)
            for ifd in ifds:
                found = []
                while at is not None and at["ifd_no"] == ifd.number:
                    found.append(writer.block(bytes(at["data"])))
                    at = next(done, None)
                tags = {e.tag: writers.repacked(e) for e in ifd.entries if e.field_type in writers.KIND_SIZE} | {259: (3, [codec.code])}
                offsets, counts = (324, 325) if ifd.get(324) else (273, 279)
                kind = 16 if ifd.big else 4
                writer.directory(tags | {offsets: (kind, [o for o, _ in found]), counts: (kind, [n for _, n in found])})

    @staticmethod
    def list_compression_methods() -> list[tuple[int, str]]:
        return [(c.code, c.name) for c in codecs.CODECS.values()]


def naming_nodata(nodata: str | None, metadata: str | None):
    """The NoData text and the metadata that holds it, as an array."""
    from gridwright.functions import colours

    text = colours.nodata_text(F.lit(nodata).cast("string"))
    return F.array(text, colours.with_nodata_item(F.lit(metadata).cast("string"), text)).alias("n")


def with_epsg(directory: list[int], epsg: int) -> list[int]:
    """A GeoKey directory whose projected system is epsg; keys stay in order."""
    keys = [tuple(directory[4 + 4 * k : 8 + 4 * k]) for k in range(directory[3])]
    keys = sorted([k for k in keys if k[0] != 3072] + [(3072, 0, 1, epsg)])
    return [*directory[:3], len(keys), *(n for k in keys for n in k)]


def transcoded(blocks: DataFrame, path: str, target: int) -> DataFrame:
    """blocks (ifd_no, block_no, compression, offset, byte_count) of a file with their data in another compression."""
    import pyarrow as pa

    def run(batches):
        system, inner = tiff.opened(path)
        with system.open_input_file(inner) as f:
            for batch in batches:
                data = []
                for r in batch.to_pylist():
                    f.seek(r["offset"])
                    data.append(codecs.convert(f.read(r["byte_count"]), r["compression"], target))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["ifd_no", "block_no", "data"])

    parts = max(1, math.ceil(blocks.count() / tiff.PARTITION_BLOCKS))
    return blocks.repartition(parts).mapInArrow(run, "ifd_no int, block_no int, data binary")


