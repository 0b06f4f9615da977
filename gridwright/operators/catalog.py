"""Catalogue operators over directories (ifds) and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.functions import names

#: Tags that hold a file's layout and are written anew with an image.
LAYOUT_TAGS = (256, 257, 258, 259, 262, 273, 277, 278, 279, 280, 281, 284, 317, 320, 322, 323, 324, 325, 33550, 33922, 34735, 34736, 34737, 42112, 42113)


def overviews(ifds: DataFrame) -> DataFrame:
    """Directories of reduced images: bit 0 of NewSubfileType."""
    return ifds.where(F.col("subfile").bitwiseAND(1) == 1)


def geotiff_tags(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("tag").isin(*names.GEOTIFF_TAGS))


def last_wins(tags: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Of several entries of a tag the one added last (seq)."""
    rank = F.row_number().over(Window.partitionBy(*by, "tag").orderBy(F.desc("seq")))
    return tags.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def copy_except(tags: DataFrame, excluded=LAYOUT_TAGS) -> DataFrame:
    return tags.where(~F.col("tag").isin(*excluded))


def first_tags(tags: DataFrame, n: int = 10, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """The first n entries of each file, by tag number."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("tag", "seq"))
    return tags.withColumn("rank", rank).where(F.col("rank") <= n)


def describe_tags(tags: DataFrame) -> DataFrame:
    return tags.withColumns({"tag_name": names.tag_name(F.col("tag")), "type_name": names.field_type_name(F.col("field_type"))})


def summary(ifds: DataFrame) -> DataFrame:
    """What an analysis shows of each directory."""
    return ifds.select(
        "path", "ifd_no", "ifd_offset", "entry_count", "width", "height", "samples", "compression",
        names.compression_name(F.col("compression")).alias("compression_name"),
        F.col("compression").isin(1, 8, 14, 32946, 50000).alias("supported"),
        F.when(F.col("subfile").bitwiseAND(1) == 1, "overview").otherwise("full resolution").alias("kind"),
        names.photometric_name(F.col("photometric")).alias("photometric_name"),
        names.predictor_name(F.col("predictor")).alias("predictor_name"),
        names.planar_name(F.col("planar")).alias("planar_name"),
        names.sample_format_name(F.col("sample_format")).alias("sample_format_name"),
        names.describe_projection(F.coalesce("epsg", F.lit(0)), F.coalesce("projection", F.lit(0)), F.coalesce("geographic", F.lit(0))).alias("projection"),
        "scale", "tiepoint", "nodata",
    )
