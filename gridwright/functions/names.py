"""Names of tags, types and codes, as literal maps (small) or a rule; larger code tables are read from a file."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.code_tables import CODE_TABLES

# Tags, field types and codes of the TIFF and GeoTIFF formats with the names that results show.
TAG_NAMES = {
    254: "NewSubfileType", 255: "SubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation",
    266: "FillOrder", 273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 280: "MinSampleValue",
    281: "MaxSampleValue", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 296: "ResolutionUnit", 301: "TransferFunction", 305: "Software",
    306: "DateTime", 315: "Artist", 316: "HostComputer", 317: "Predictor", 320: "ColorMap", 322: "TileWidth", 323: "TileLength", 324: "TileOffsets",
    325: "TileByteCounts", 339: "SampleFormat", 33432: "Copyright", 33550: "ModelPixelScale", 33922: "ModelTiepoint", 34264: "ModelTransformation",
    34735: "GeoKeyDirectory", 34736: "GeoDoubleParams", 34737: "GeoAsciiParams", 42112: "GDALMetadata", 42113: "GDALNoData",
}
FIELD_TYPES = {1: "BYTE", 2: "ASCII", 3: "SHORT", 4: "LONG", 5: "RATIONAL", 6: "SBYTE", 7: "UNDEFINED", 8: "SSHORT", 9: "SLONG", 10: "SRATIONAL", 11: "FLOAT", 12: "DOUBLE", 16: "LONG8", 17: "SLONG8", 18: "IFD8"}
COMPRESSIONS = {1: "None", 2: "CCITT RLE", 3: "CCITT Group 3 Fax", 4: "CCITT Group 4 Fax", 5: "LZW", 6: "Old JPEG", 7: "JPEG", 8: "Adobe Deflate", 9: "JBIG (B&W)", 10: "JBIG (Color)", 14: "Zstandard", 32773: "PackBits"}
COMPRESSIONS_LONG = {1: "Uncompressed", 2: "CCITT RLE", 3: "CCITT Group 3 fax", 4: "CCITT Group 4 fax", 5: "LZW", 6: "JPEG (old-style)", 7: "JPEG", 8: "Adobe Deflate (zlib)", 9: "JBIG B&W", 10: "JBIG Color", 14: "ZSTD", 32773: "PackBits"}
PHOTOMETRICS = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "Palette", 4: "TransparencyMask", 5: "CMYK", 6: "YCbCr", 8: "CIELAB"}
PHOTOMETRICS_LONG = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "Palette Color", 4: "Transparency Mask", 5: "CMYK", 6: "YCbCr", 8: "CIE L*a*b*"}
SAMPLE_FORMATS = {1: "Unsigned integer", 2: "Signed integer", 3: "IEEE floating point", 4: "Undefined", 5: "Complex integer", 6: "Complex floating point"}
PREDICTORS = {1: "No prediction scheme", 2: "Horizontal differencing", 3: "Floating point predictor"}
PLANARS = {1: "Chunky (interleaved)", 2: "Planar (separate)"}
GEO_TAGS = {33550: "ModelPixelScaleTag", 34264: "ModelTransformationTag", 33922: "ModelTiepointTag", 34735: "GeoKeyDirectoryTag", 34736: "GeoDoubleParamsTag", 34737: "GeoAsciiParamsTag", 33920: "IntergraphMatrixTag"}
GEO_KEYS = {
    1024: "GTModelTypeGeoKey", 1025: "GTRasterTypeGeoKey", 1026: "GTCitationGeoKey", 2048: "GeographicTypeGeoKey", 2049: "GeogCitationGeoKey", 2050: "GeogGeodeticDatumGeoKey",
    2051: "GeogPrimeMeridianGeoKey", 2052: "GeogLinearUnitsGeoKey", 2053: "GeogLinearUnitSizeGeoKey", 2054: "GeogAngularUnitsGeoKey", 2055: "GeogAngularUnitSizeGeoKey",
    2056: "GeogEllipsoidGeoKey", 2057: "GeogSemiMajorAxisGeoKey", 2058: "GeogSemiMinorAxisGeoKey", 2059: "GeogInvFlatteningGeoKey", 2060: "GeogAzimuthUnitsGeoKey",
    2061: "GeogPrimeMeridianLongGeoKey", 3072: "ProjectedCSTypeGeoKey", 3073: "PCSCitationGeoKey", 3074: "ProjectionGeoKey", 3075: "ProjCoordTransGeoKey",
    3076: "ProjLinearUnitsGeoKey", 3077: "ProjLinearUnitSizeGeoKey", 3078: "ProjStdParallel1GeoKey", 3079: "ProjStdParallel2GeoKey", 3080: "ProjNatOriginLongGeoKey",
    3081: "ProjNatOriginLatGeoKey", 3082: "ProjFalseEastingGeoKey", 3083: "ProjFalseNorthingGeoKey", 3084: "ProjFalseOriginLongGeoKey", 3085: "ProjFalseOriginLatGeoKey",
    3086: "ProjFalseOriginEastingGeoKey", 3087: "ProjFalseOriginNorthingGeoKey", 3088: "ProjCenterLongGeoKey", 3089: "ProjCenterLatGeoKey", 3090: "ProjCenterEastingGeoKey",
    3091: "ProjFalseOriginNorthingGeoKey", 3092: "ProjScaleAtNatOriginGeoKey", 3093: "ProjScaleAtCenterGeoKey", 3094: "ProjAzimuthAngleGeoKey", 3095: "ProjStraightVertPoleLongGeoKey",
    4096: "VerticalCSTypeGeoKey", 4097: "VerticalCitationGeoKey", 4098: "VerticalDatumGeoKey", 4099: "VerticalUnitsGeoKey",
}
CODES = {
    "model_type": {1: "ModelTypeProjected", 2: "ModelTypeGeographic", 3: "ModelTypeGeocentric"},
    "raster_type": {1: "RasterPixelIsArea", 2: "RasterPixelIsPoint"},
    "linear_unit": {9001: "Linear_Meter", 9002: "Linear_Foot", 9003: "Linear_Foot_US_Survey", 9004: "Linear_Foot_Modified_American", 9005: "Linear_Foot_Clarke", 9006: "Linear_Foot_Indian", 9007: "Linear_Link", 9008: "Linear_Link_Benoit", 9009: "Linear_Link_Sears", 9010: "Linear_Chain_Benoit", 9011: "Linear_Chain_Sears", 9012: "Linear_Yard_Sears", 9013: "Linear_Yard_Indian", 9014: "Linear_Fathom", 9015: "Linear_Mile_International_Nautical"},
    "angular_unit": {9101: "Angular_Radian", 9102: "Angular_Degree", 9103: "Angular_Arc_Minute", 9104: "Angular_Arc_Second", 9105: "Angular_Grad", 9106: "Angular_Gon", 9107: "Angular_DMS", 9108: "Angular_DMS_Hemisphere"},
}
CODES |= CODE_TABLES
#: The table that a key's values are taken from.
KEY_TABLES = {
    1024: "model_type", 1025: "raster_type", 2048: "geographic_cs", 2050: "geodetic_datum", 2051: "prime_meridian", 2052: "linear_unit", 2054: "angular_unit", 2056: "ellipsoid", 2060: "angular_unit",
    3075: "coord_transformation", 3076: "linear_unit", 4096: "vertical_cs", 4099: "linear_unit",
}
# Descriptions of projected systems, (first code, last code, text, number taken off for the zone or None).
PROJECTED = (
    (3857, 3857, "WGS 84 / Web Mercator (Google Maps, OpenStreetMap)", None),
    (4326, 4326, "WGS 84 (GPS, standard latitude/longitude)", None),
    (3395, 3395, "WGS 84 / World Mercator", None),
    (4269, 4269, "NAD 83 (North American Datum 1983)", None),
    (4267, 4267, "NAD 27 (North American Datum 1927)", None),
    (32600, 32660, "WGS 84 / UTM Northern Hemisphere zone {}", 32600),
    (32700, 32760, "WGS 84 / UTM Southern Hemisphere zone {}", 32700),
    (26900, 26923, "NAD 83 / UTM zone {} North", 26900),
    (26700, 26722, "NAD 27 / UTM zone {} North", 26700),
    (2000, 2056, "NAD 83 / State Plane (US)", None),
    (3035, 3035, "ETRS89 / LAEA Europe (Lambert Azimuthal Equal Area)", None),
    (3034, 3034, "ETRS89 / LCC Europe (Lambert Conformal Conic)", None),
    (3038, 3051, "ETRS89 / TM zone (European Transverse Mercator)", None),
    (27700, 27700, "OSGB 1936 / British National Grid", None),
    (2180, 2180, "ETRS89 / Poland CS92", None),
    (2154, 2154, "RGF93 / Lambert-93 (France)", None),
    (25830, 25838, "ETRS89 / UTM zone {} North (Europe)", 25830),
    (3112, 3112, "GDA94 / Geoscience Australia Lambert", None),
    (28348, 28358, "GDA94 / MGA zone {}", 28300),
    (3157, 3157, "NAD 83 / Canada Atlas Lambert", None),
    (2960, 2962, "NAD 83 / Quebec Lambert", None),
    (4490, 4490, "CGCS 2000 (China)", None),
    (4479, 4479, "China Geodetic Coordinate System 2000", None),
    (6933, 6933, "WGS 84 / NSIDC EASE-Grid 2.0 Global", None),
    (6931, 6932, "WGS 84 / NSIDC EASE-Grid 2.0 (equal area)", None),
    (5070, 5070, "NAD 83 / Conus Albers (US)", None),
    (6350, 6350, "EPSG / WGS 84 / UPS North (E,N)", None),
    (6351, 6351, "WGS 84 / UPS South (E,N)", None),
)
METHODS = {1: "Geographic (lat/long)", 9: "Mercator", 10: "Stereographic", 11: "Transverse Mercator"}
GEOTIFF_TAGS = tuple(GEO_TAGS)


def lookup(names: dict[int, str], code: Column, default: Column | str = "Unknown") -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code.cast("int")), default if isinstance(default, Column) else F.lit(default))


def tag_name(tag: Column) -> Column:
    return lookup(TAG_NAMES, tag)


def geo_tag_name(tag: Column) -> Column:
    return lookup(GEO_TAGS, tag, F.concat(F.lit("Unknown-"), tag.cast("string")))


def geo_key_name(key: Column) -> Column:
    return lookup(GEO_KEYS, key, F.concat(F.lit("Unknown-"), key.cast("string")))


def field_type_name(code: Column) -> Column:
    return lookup(FIELD_TYPES, code)


def compression_name(code: Column, long: bool = False) -> Column:
    return lookup(COMPRESSIONS_LONG if long else COMPRESSIONS, code)


def photometric_name(code: Column, long: bool = False) -> Column:
    return lookup(PHOTOMETRICS_LONG if long else PHOTOMETRICS, code)


def sample_format_name(code: Column) -> Column:
    return lookup(SAMPLE_FORMATS, code)


def predictor_name(code: Column) -> Column:
    return lookup(PREDICTORS, code)


def planar_name(code: Column) -> Column:
    return lookup(PLANARS, code)


def describe_projected(code: Column, other: Column | None = None) -> Column:
    """The listed descriptions come before `other`, a name from a code table; without either it is EPSG:n."""
    found = F.coalesce(other, F.concat(F.lit("EPSG:"), code.cast("string"))) if other is not None else F.concat(F.lit("EPSG:"), code.cast("string"))
    for first, last, text, off in reversed(PROJECTED):
        head, _, tail = text.partition("{}")
        own = F.lit(text) if off is None else F.concat(F.lit(head), (code - off).cast("string"), F.lit(tail))
        found = F.when(code.between(first, last), own).otherwise(found)
    return found


def geo_key_text(key: Column, location: Column, code: Column, value: Column) -> Column:
    """A GeoKey's value as shown: the name of a code, the description of a projected system, else the value itself."""
    found = F.when(key == 3072, describe_projected(code))
    for k, table in KEY_TABLES.items():
        found = found.when(key == k, lookup(CODES[table], code, value))
    return F.when(location == 0, found.otherwise(value)).otherwise(value)


def describe_projection(epsg: Column, method: Column, geographic: Column) -> Column:
    number = lambda text, c: F.concat(F.lit(text), c.cast("string"))
    return (
        F.when(epsg == 3857, "Web Mercator (EPSG:3857)")
        .when(epsg == 4326, "WGS84 Geographic (EPSG:4326)")
        .when(epsg > 0, number("EPSG:", epsg))
        .when(method > 0, lookup(METHODS, method, number("Projection code: ", method)))
        .when(geographic > 0, number("Geographic CS: ", geographic))
        .otherwise("Unknown projection")
    )


def code_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """code_type, code, name. path: a TOML file of sections `<type>_codes` with lines `code = "name"`, read through
    Spark, which adds to and overrides the tables above; keys that are no 16-bit number are passed over."""
    tables = {k: dict(v) for k, v in CODES.items()} | {"tag": dict(GEO_TAGS), "key": dict(GEO_KEYS)}
    if path:
        text = spark.read.text(path, wholetext=True).first()[0]
        for section, entries in tomllib.loads(text).items():
            kind = section.removesuffix("_codes").removesuffix("_ids")
            tables.setdefault(kind, {}).update({int(k): str(v) for k, v in entries.items() if k.isdigit() and int(k) < 65_536})
    rows = [(kind, code, name) for kind, names in tables.items() for code, name in names.items()]
    return spark.createDataFrame(rows, "code_type string, code int, name string")


def name_codes(df: DataFrame, codes: DataFrame, code_type: str, code: str, name: str) -> DataFrame:
    """df with the name of its code; an unknown code keeps its number as text. The table is small, a code occurs once."""
    table = codes.where(F.col("code_type") == code_type).groupBy(F.col("code").alias("_code")).agg(F.max("name").alias("_name"))
    return df.join(table, df[code] == table["_code"], "left").withColumn(name, F.coalesce("_name", F.col(code).cast("string"))).drop("_code", "_name")
