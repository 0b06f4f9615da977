"""Pixel operators over DataFrames with x, y and v (or r, g, b[, a]): all of them expressions of Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.errors import BadRequest
from gridwright.functions.colours import luma


def grey_to_rgb(df: DataFrame, v: str = "v") -> DataFrame:
    return df.select(*(c for c in df.columns if c != v), F.col(v).alias("r"), F.col(v).alias("g"), F.col(v).alias("b"))


def rgb_to_grey(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in ("r", "g", "b", "a")), luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def check_window(x: int, y: int, width: int, height: int, image_width: int, image_height: int) -> None:
    """A window must have a size and lie in the image."""
    if width <= 0 or height <= 0 or x < 0 or y < 0 or x + width > image_width or y + height > image_height:
        raise BadRequest(f"window {x},{y} {width}x{height} is not inside {image_width}x{image_height}")


def crop(df: DataFrame, x, y, width, height, rebase: bool = True) -> DataFrame:
    """Pixels with x <= column < x + width and y <= row < y + height, counted from the window's corner."""
    x, y, width, height = (c if isinstance(c, Column) else F.lit(c) for c in (x, y, width, height))
    inside = df.where((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height))
    return inside.withColumns({"x": (F.col("x") - x).cast("int"), "y": (F.col("y") - y).cast("int")}) if rebase else inside


def parse_range(text: str) -> tuple[int, int]:
    """ "min,max", both from 0 to 255, min not above max."""
    found = re.fullmatch(r"\s*\+?(\d{1,9})\s*,\s*\+?(\d{1,9})\s*", text)
    if not found or not 0 <= int(found[1]) <= int(found[2]) <= 255:
        raise BadRequest(f"need min,max from 0 to 255: {text!r}")
    return int(found[1]), int(found[2])


def value_filter(df: DataFrame, low: int, high: int, background: int = 0) -> DataFrame:
    """Values outside low..high become the background; no pixel is dropped."""
    return df.withColumn("v", F.when(F.col("v").between(low, high), F.col("v")).otherwise(F.lit(background)))


def value_filter_alpha(df: DataFrame, low: int, high: int) -> DataFrame:
    """Values in low..high as opaque grey, others as transparent black."""
    kept = F.col("v").between(low, high)
    own = F.when(kept, F.col("v")).otherwise(F.lit(0))
    return df.select(*(c for c in df.columns if c != "v"), own.alias("r"), own.alias("g"), own.alias("b"), F.when(kept, 255).otherwise(0).alias("a"))


def in_circle(width, height, x: str = "x", y: str = "y") -> Column:
    """Whether a pixel's corner lies in the circle in the middle, its radius half of the shorter side, rounded down."""
    width, height = (c if isinstance(c, Column) else F.lit(c) for c in (width, height))
    dx, dy = F.col(x).cast("long") * 2 - width, F.col(y).cast("long") * 2 - height
    across = F.floor(F.least(width, height) / 2) * 2
    return dx * dx + dy * dy <= across * across


def circle_mask(df: DataFrame, width, height) -> DataFrame:
    """RGBA pixels; outside of the circle all four are 0. Pixels without a are opaque."""
    kept = in_circle(width, height)
    alpha = F.col("a") if "a" in df.columns else F.lit(255)
    rest = [c for c in df.columns if c not in ("r", "g", "b", "a")]
    return df.select(*rest, *(F.when(kept, F.col(c)).otherwise(0).alias(c) for c in "rgb"), F.when(kept, alpha).otherwise(0).alias("a"))


def grey_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Smallest and largest value; 255 and 0 for no pixels."""
    found = (F.coalesce(F.min("v"), F.lit(255)).cast("int").alias("min_value"), F.coalesce(F.max("v"), F.lit(0)).cast("int").alias("max_value"))
    return df.groupBy(*by).agg(*found) if by else df.agg(*found)


def rgb_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same for each channel and over all three."""
    each = [f(c) for c in "rgb" for f in (lambda c: F.coalesce(F.min(c), F.lit(255)).cast("int").alias(f"min_{c}"), lambda c: F.coalesce(F.max(c), F.lit(0)).cast("int").alias(f"max_{c}"))]
    found = df.groupBy(*by).agg(*each) if by else df.agg(*each)
    return found.withColumns({"min_value": F.least("min_r", "min_g", "min_b"), "max_value": F.greatest("max_r", "max_g", "max_b")})


def predictor_encode(df: DataFrame, rows: tuple[str, ...] = ("y",)) -> DataFrame:
    """Each value less its left neighbour, modulo 256; the first of a row as it is."""
    line = Window.partitionBy(*rows).orderBy("x")
    return df.withColumn("v", F.pmod(F.col("v") - F.coalesce(F.lag("v").over(line), F.lit(0)), F.lit(256)).cast("int"))


def predictor_decode(df: DataFrame, rows: tuple[str, ...] = ("y",)) -> DataFrame:
    """The running sum along each row, modulo 256."""
    line = Window.partitionBy(*rows).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("v", F.pmod(F.sum("v").over(line), F.lit(256)).cast("int"))


def block_grid(df: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of each block of this size: bx, by, their number, smallest and largest value."""
    bx, by = F.floor(F.col("x") / width).cast("int"), F.floor(F.col("y") / height).cast("int")
    return df.groupBy(bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def blocks_of_region(blocks: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Blocks (x0, y0, w, h) that overlap the region. A filter on the blocks' own columns, so sources can prune by it."""
    return blocks.where((F.col("x0") < x + width) & (F.col("y0") < y + height) & (F.col("x0") + F.col("w") > x) & (F.col("y0") + F.col("h") > y))


def rows_of(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """y and row: the values of each line in the order of x. A group is a line, whose length the image bounds."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "v")))
    return df.groupBy(*by, "y").agg(ordered.alias("p")).select(*by, "y", F.transform("p", lambda p: p["v"]).alias("row"))


def csv_rows(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows_of(df, by).select(*by, "y", F.concat_ws(",", F.col("y").cast("string"), F.array_join(F.col("row").cast("array<string>"), ",")).alias("line"))


def json_rows(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows_of(df, by).select(*by, "y", F.concat(F.lit("    ["), F.array_join(F.col("row").cast("array<string>"), ", "), F.lit("]")).alias("line"))


def value_at(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """The value at a place of rows_of(); null outside of the image."""
    return rows.where(F.col("y") == y).select("y", F.when(x >= 0, F.get("row", x.cast("int"))).alias("v"))
