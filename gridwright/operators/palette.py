"""Colormaps as DataFrames (value, label, r, g, b): lookup tables, application, palettes, SLD and CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.functions.colours import escape_xml, hex_decode, hex_encode, lerp

#: The lines around the entries of a style document.
SLD_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<StyledLayerDescriptor xmlns="http://www.opengis.net/sld" version="1.0.0" xmlns:gml="http://www.opengis.net/gml" xmlns:sld="http://www.opengis.net/sld" xmlns:ogc="http://www.opengis.net/ogc">
  <UserLayer>
    <sld:LayerFeatureConstraints>
      <sld:FeatureTypeConstraint/>
    </sld:LayerFeatureConstraints>
    <sld:UserStyle>
      <sld:Name>{name}</sld:Name>
      <sld:FeatureTypeStyle>
        <sld:Rule>
          <sld:RasterSymbolizer>
            <sld:ChannelSelection>
              <sld:GrayChannel>
                <sld:SourceChannelName>1</sld:SourceChannelName>
              </sld:GrayChannel>
            </sld:ChannelSelection>
            <sld:ColorMap type="{kind}">
"""
SLD_TAIL = """            </sld:ColorMap>
          </sld:RasterSymbolizer>
        </sld:Rule>
      </sld:FeatureTypeStyle>
    </sld:UserStyle>
  </UserLayer>
</StyledLayerDescriptor>
"""


def lookup_table(colormap: DataFrame, kind: str = "ramp") -> DataFrame:
    """v (0 to 255), r, g, b. Of several entries of a value the first listed (column seq, if there is one) counts.

    255 is white, whatever the entries say, and so is black where there are none. Values with an entry take it; others
    lie between their neighbours on a ramp of two entries or more, and else take the nearest, the lower one of two.
    The entries, at most one for each 16-bit value, become one sorted array, in which each of the 256 values is looked up.
    """
    order = F.min(F.struct("seq", "r", "g", "b")) if "seq" in colormap.columns else F.min(F.struct("r", "g", "b"))
    first = colormap.groupBy("value").agg(order.alias("c")).select(F.struct("value", "c.r", "c.g", "c.b").alias("e"))
    sorted_ones = first.agg(F.array_sort(F.collect_list("e")).alias("es"))  # one row
    domain = colormap.sparkSession.range(0, 256, 1, 1).select(F.col("id").cast("int").alias("v")).crossJoin(F.broadcast(sorted_ones))
    below = F.filter("es", lambda e: e["value"] <= F.col("v"))
    above = F.filter("es", lambda e: e["value"] >= F.col("v"))
    around = domain.select("v", F.size("es").alias("entries"), F.get(below, F.size(below) - 1).alias("lo"), F.get(above, F.lit(0)).alias("hi"))
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    t = (F.col("v") - F.col("lo.value")).cast("float") / F.nullif(F.col("hi.value") - F.col("lo.value"), F.lit(0)).cast("float")
    nearer = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(F.col("v") - F.col("lo.value") <= F.col("hi.value") - F.col("v"), F.col("lo")).otherwise(F.col("hi"))

    def channel(c: str) -> Column:
        between = lerp(F.col(f"lo.{c}"), F.col(f"hi.{c}"), t.cast("float")) if kind == "ramp" else nearer[c]
        other = F.when(both & (F.col("entries") > 1), between).otherwise(nearer[c])
        return F.when(F.col("v") == 255, 255).when(F.col("entries") == 0, 0).when(F.col("lo.value") == F.col("v"), F.col(f"lo.{c}")).otherwise(other).cast("int").alias(c)

    return around.select("v", *(channel(c) for c in "rgb"))


def apply_colormap(pixels: DataFrame, colormap: DataFrame, kind: str = "ramp") -> DataFrame:
    """Pixels with r, g, b for v. The table has 256 rows, so it is broadcast."""
    table = lookup_table(colormap, kind)
    return pixels.join(F.broadcast(table), "v").select(*(c for c in pixels.columns if c != "v"), "r", "g", "b")


def palette_size(colormap: DataFrame) -> DataFrame:
    """max_value, bits (1 at least) and size: the smallest power of two that holds every value."""
    top = colormap.agg(F.coalesce(F.max("value"), F.lit(0)).cast("long").alias("max_value"))
    bits = F.greatest(F.lit(1), F.length(F.bin("max_value")))
    return top.select("max_value", bits.cast("int").alias("bits"), F.pow(F.lit(2.0), bits).cast("long").alias("size"))


def palette_table(colormap: DataFrame, size: int) -> DataFrame:
    """v, r, g, b in 16 bits (a byte times 257) for 0..size-1: entries, the gaps between them in even steps of whole
    numbers, and black before the first and after the last."""
    spark = colormap.sparkSession
    entries = colormap.groupBy("value").agg(F.min(F.struct("r", "g", "b")).alias("c")).select(F.col("value").alias("v"), "c")
    domain = spark.range(size).select(F.col("id").cast("int").alias("v"))
    pairs = entries.select("v", "c", F.lead("v").over(Window.orderBy("v")).alias("v2"), F.lead("c").over(Window.orderBy("v")).alias("c2"))
    step = lambda c, i: F.col(f"c.{c}") * 257 + F.floor((F.col(f"c2.{c}") * 257 - F.col(f"c.{c}") * 257) * i / (F.col("v2") - F.col("v")))
    inner = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("v2") - F.col("v") - 1, F.lit(0)))))
    filled = inner.select((F.col("v") + F.col("i")).cast("int").alias("v"), *(F.when(F.col("i") == 0, F.col(f"c.{c}") * 257).otherwise(step(c, F.col("i"))).cast("int").alias(c) for c in "rgb"))
    return domain.join(filled, "v", "left").select("v", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))


def strip_leading_black(entries: DataFrame) -> DataFrame:
    """Entries from the first that isn't black; none if all are."""
    start = entries.where("r + g + b > 0").agg(F.min("value").alias("_start"))
    return entries.join(F.broadcast(start), entries["value"] >= start["_start"]).drop("_start")


def distinct_colours(entries: DataFrame) -> DataFrame:
    """Of equal colours the entry with the smallest value."""
    return entries.groupBy("r", "g", "b").agg(F.min("value").alias("value")).select("value", "r", "g", "b")


def sld_lines(colormap: DataFrame) -> DataFrame:
    """value and line: an element for each entry; the label is the value where there is none."""
    label = F.coalesce(F.col("label"), F.col("value").cast("string"))
    line = F.concat(F.lit('              <sld:ColorMapEntry quantity="'), F.col("value").cast("string"), F.lit('" label="'), escape_xml(label), F.lit('" color="'), hex_encode(F.col("r"), F.col("g"), F.col("b")), F.lit('"/>'))
    return colormap.select("value", line.alias("line"))


def _attribute(line: Column, name: str) -> Column:
    return F.regexp_extract(line, rf'{name}="([^"]*)"', 1)


def parse_sld_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """value, label, r, g, b of the lines with an entry; those without a number or a colour are passed over."""
    own = lines.where(F.col(line).contains("ColorMapEntry"))
    number = F.expr("try_cast(q as double)")
    found = own.withColumn("q", _attribute(F.col(line), "quantity")).withColumn("c", hex_decode(_attribute(F.col(line), "color"))).where(F.col("c").isNotNull() & number.isNotNull())
    value = F.least(F.greatest(F.expr("cast(q as double)"), F.lit(0.0)), F.lit(65535.0)).cast("int")
    return found.select(*(x for x in lines.columns if x != line), value.alias("value"), F.nullif(_attribute(F.col(line), "label"), F.lit("")).alias("label"), "c.r", "c.g", "c.b")


def parse_csv_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same of value,hex / value,hex,label / value,r,g / value,r,g,b / value,r,g,b,label."""
    text = F.trim(line)
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    own = lines.where((text != "") & ~text.startswith("#")).withColumn("p", parts).withColumn("n", F.size("p"))
    own = own.withColumn("c", hex_decode(F.get("p", F.lit(1))))
    byte = lambda i: F.expr(f"try_cast(get(p, {i}) as int)")
    valid = lambda i: byte(i).between(0, 255)
    as_hex = F.col("n").isin(2, 3) & F.col("c").isNotNull()
    as_bytes = ((F.col("n") == 3) & F.col("c").isNull() & valid(1) & valid(2)) | (F.col("n").isin(4, 5) & valid(1) & valid(2) & valid(3))
    kept = own.where(F.expr("try_cast(get(p, 0) as int)").between(0, 65535) & (as_hex | F.coalesce(as_bytes, F.lit(False))))
    pick = lambda c, i: F.when(as_hex, F.col(f"c.{c}")).when((F.col("n") == 3) & (F.lit(i) == 3), F.lit(0)).otherwise(byte(i)).alias(c)
    label = F.when(as_hex & (F.col("n") == 3), F.get("p", F.lit(2))).when(F.col("n") == 5, F.get("p", F.lit(4)))
    return kept.select(*(x for x in lines.columns if x != line), F.expr("try_cast(get(p, 0) as int)").alias("value"), label.alias("label"), pick("r", 1), pick("g", 2), pick("b", 3))
