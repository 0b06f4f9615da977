"""Colours as Column expressions, and the two text formats of NoData and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_encode(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def hex_decode(text: Column) -> Column:
    """Struct r, g, b of six hex digits after any number of #; null for anything else."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), "^#*([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """The weighted mean of two channels in 32-bit floats, cut to a byte. t: the second's weight, a float."""
    mean = a.cast("float") * (F.lit(1.0).cast("float") - t) + b.cast("float") * t
    return F.greatest(F.lit(0), F.least(F.lit(255), mean.cast("int")))


def luma(r: Column, g: Column, b: Column) -> Column:
    """The grey value of a colour, by integer weights; a grey colour keeps its value."""
    return F.floor((r * 2126 + g * 7152 + b * 722) / 10000).cast("int")


def escape_xml(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def nodata_text(text: Column) -> Column:
    """NoData as it is written: trimmed; nothing, null and :w become 255."""
    own = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(own.isin("", ":w"), "255").otherwise(own)


def with_nodata_item(xml: Column, value: Column) -> Column:
    """Metadata whose NODATA_VALUES item holds value: replaced, added before the end, or in a new document."""
    item = F.concat(F.lit('<Item name="NODATA_VALUES">'), value, F.lit("</Item>"))
    fresh = F.concat(F.lit("<GDALMetadata>\n  "), item, F.lit("\n</GDALMetadata>"))
    opening = F.lit('<Item name="NODATA_VALUES"')
    at = F.locate('<Item name="NODATA_VALUES"', xml)
    rest = F.substr(xml, at + F.length(opening))
    end = F.instr(rest, "</Item>")
    replaced = F.concat(F.substr(xml, F.lit(1), at - 1), item, F.substr(rest, end + len("</Item>")))
    close = F.locate("</GDALMetadata>", xml)
    added = F.concat(F.when(close > 0, F.substr(xml, F.lit(1), close - 1)).otherwise(F.concat(xml, F.lit("\n"))), F.lit("  "), item, F.lit("\n</GDALMetadata>"))
    return F.when(xml.isNull(), fresh).when(at > 0, F.when(end > 0, replaced).otherwise(fresh)).otherwise(added)
