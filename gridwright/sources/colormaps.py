"""Colormap files: SLD, CSV or TXT, and palettes of TIFF files, as DataFrames of entries with their order (seq)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.errors import BadRequest, MissingTag, Unsupported
from gridwright.operators import palette
from gridwright.sources import tiff


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a small text file, in order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))


def kind_of(spark: SparkSession, path: str) -> str:
    """sld, csv or tiff, by the extension, or else by the first ten lines."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ending in ("sld", "csv", "txt", "tif", "tiff"):
        return {"txt": "csv", "tif": "tiff"}.get(ending, ending)
    head = "\n".join(r["line"] for r in _lines(spark, path).where("seq < 10").orderBy("seq").collect())
    return "sld" if re.search(r"<\?xml|StyledLayerDescriptor|ColorMap", head) else "csv"


def palette_entries(ifd: tiff.Ifd) -> list[tuple[int, None, int, int, int]]:
    """Entries of a palette image: 16-bit channels over 257, leading black ones left out; of more than 256 entries the
    first of each colour."""
    if ifd.one(262) != 3:
        raise Unsupported("not a palette image")
    bits, table = ifd.one(258, 8), ifd.ints(320)
    n = 1 << bits
    if not table:
        raise MissingTag("no ColorMap")
    if len(table) != 3 * n:
        raise BadRequest(f"a ColorMap of {len(table)} numbers; {3 * n} are needed")
    found = [(v, None, *(table[v + k * n] // 257 for k in range(3))) for v in range(n)]
    first = next((i for i, e in enumerate(found) if any(e[2:])), len(found))
    found = found[first:]
    if len(found) > 256:
        found = list({e[2:]: e for e in reversed(found)}.values())
        found.sort()
    return found


def read_colormap(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(entries, type): value, label, r, g, b and seq; the type is a style's, else ramp."""
    kind, map_type = kind_of(spark, path), "ramp"
    if kind == "tiff":
        ifds = tiff.load(path)
        if not ifds:
            raise MissingTag("no directory")
        found = spark.createDataFrame([(*e, i) for i, e in enumerate(palette_entries(ifds[0]))], "value int, label string, r int, g int, b int, seq int")
    else:
        lines = _lines(spark, path)
        found = palette.parse_sld_lines(lines) if kind == "sld" else palette.parse_csv_lines(lines)
        if kind == "sld":
            heads = lines.where(F.col("line").contains("ColorMap") & F.col("line").contains("type=")).orderBy("seq").limit(1).collect()
            map_type = (re.findall(r'type="([^"]*)"', heads[0]["line"]) if heads else []) or ["ramp"]
            map_type = map_type[0]
    if found.isEmpty():
        raise BadRequest(f"no colour in {path}")
    return found, map_type


def sld_text(entries: DataFrame, name: str, kind: str = "ramp") -> str:
    """A style document of the entries, which are few, in the order of their values."""
    from xml.sax.saxutils import escape

    rows = palette.sld_lines(entries).orderBy("value").collect()
    own = escape(name, {"'": "&apos;", '"': "&quot;"})
    return palette.SLD_HEAD.format(name=own, kind=kind) + "".join(r["line"] + "\n" for r in rows) + palette.SLD_TAIL
