"""Coordinates as Column expressions: projections, buffers, geotransforms, and regions of pixels.

A geotransform is given by its four columns ox, pw, oy, ph (ph negative for north-up images); a box by four columns.
Numbers that stand for u32 or u8 are cut to their range before a cast, so ANSI mode never raises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius; the rounded half circumference and the latitude limits of the two projections;
#: metres in a degree; the radius in metres of a fallback region is taken over the pixel's width.
RADIUS, HALF_WORLD, LIMIT, LIMIT_BOX, DEGREE = 6378137.0, 20037508.34, 85.05, 85.06, 111_320.0
METRIC = (3857, 3785, 900913)
FALLBACK = 1000

Box = tuple[Column, Column, Column, Column]


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi)


def to_u32(v: Column) -> Column:
    """A double as an unsigned 32-bit number: towards zero, cut to the range; NaN is 0."""
    return F.when(F.isnan(v), F.lit(0).cast("long")).otherwise(clamp(v, 0.0, 4294967295.0).cast("long"))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    lat = clamp(lat, -LIMIT, LIMIT)
    return lon * (RADIUS * math.pi / 180), F.log(F.tan((lat + 90) * (math.pi / 360))) * RADIUS


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x * (180 / (RADIUS * math.pi)), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def box_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The projection that boxes take: with the rounded half circumference."""
    lat = clamp(lat, -LIMIT_BOX, LIMIT_BOX)
    return lon * HALF_WORLD / 180, F.log(F.tan((lat + 90) * math.pi / 360)) * HALF_WORLD / math.pi


def transform(x: Column, y: Column, source: Column, target: Column) -> tuple[Column, Column]:
    """Between EPSG 4326 and 3857, and within any; others raise."""
    there, back = mercator(x, y), unmercator(x, y)
    bad = F.raise_error(F.concat(F.lit("no way from EPSG:"), source.cast("string"), F.lit(" to EPSG:"), target.cast("string"))).cast("double")
    pick = lambda k, same: F.when(source == target, same).when((source == 4326) & (target == 3857), there[k]).when((source == 3857) & (target == 4326), back[k]).otherwise(bad)
    return pick(0, x), pick(1, y)


def transform_box(box: Box, source: Column, target: Column) -> Box:
    """The two corners, each on its own; they are not put in order again."""
    return (*transform(box[0], box[1], source, target), *transform(box[2], box[3], source, target))


def buffer(x: Column, y: Column, radius: Column, epsg: Column) -> Box:
    """The box around a point: in degrees for EPSG 4326, else in the units of the radius."""
    dy = F.when(epsg == 4326, radius / DEGREE).otherwise(radius)
    dx = F.when(epsg == 4326, radius / (F.cos(F.radians(y)) * DEGREE)).otherwise(radius)
    return x - dx, y - dy, x + dx, y + dy


def metres_per_degree(lat: Column) -> Column:
    """The mean of a degree's length along the meridian and along the parallel."""
    p = F.radians(F.abs(lat))
    along = F.lit(111_132.92) - F.cos(p * 2) * 559.82 + F.cos(p * 4) * 1.175
    across = F.cos(p) * 111_412.84 - F.cos(p * 3) * 93.5
    return (along + across) / 2


def radius_box(x: Column, y: Column, radius: Column, epsg: Column) -> Box:
    """The box around a coordinate, whatever shape is cut out of it later: a metric EPSG, 4326, or degrees by estimate."""
    metric, degrees = epsg.isin(*METRIC), radius / metres_per_degree(y)
    dx = F.when(metric, radius).when(epsg == 4326, radius / (F.cos(F.radians(y)) * DEGREE)).otherwise(degrees)
    dy = F.when(metric, radius).when(epsg == 4326, radius / DEGREE).otherwise(degrees)
    return x - dx, y - dy, x + dx, y + dy


def parse_numbers(text: Column, names: str) -> Column:
    """ "1, 2.5" as a struct of doubles named by the letters or words of names; another number of parts raises."""
    parts, wanted = F.split(F.trim(text), r"\s*,\s*"), names.split()
    checked = F.when(F.size(parts) == len(wanted), parts).otherwise(F.raise_error(F.concat(F.lit(f"need {len(wanted)} numbers: "), text)).cast("array<string>"))
    return F.struct(*(checked[i].cast("double").alias(n) for i, n in enumerate(wanted)))


def box_contains(box: Box, x: Column, y: Column) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def box_size(box: Box) -> tuple[Column, Column, Column, Column]:
    """Width, height and centre."""
    return box[2] - box[0], box[3] - box[1], (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def grow_box(box: Box, by: Column) -> Box:
    return box[0] - by, box[1] - by, box[2] + by, box[3] + by


def geotransform(tiepoint: Column, scale: Column) -> tuple[Column, Column, Column, Column]:
    """ox, pw, oy, ph from the tie point's six and the scale's first two numbers; null where they are too few."""
    enough = (F.size(scale) >= 2) & (F.size(tiepoint) >= 6)
    own = lambda c: F.when(enough, c)
    tp, sc = (lambda i: F.get(tiepoint, F.lit(i))), (lambda i: F.get(scale, F.lit(i)))
    return own(tp(3) - tp(0) * sc(0)), own(sc(0)), own(tp(4) + tp(1) * sc(1)), own(-F.abs(sc(1)))


def raster_bounds(ox: Column, pw: Column, oy: Column, ph: Column, width: Column, height: Column) -> Box:
    return ox, oy + height * ph, ox + width * pw, oy


def shifted_origin(ox: Column, pw: Column, oy: Column, ph: Column, rx: Column, ry: Column) -> tuple[Column, Column]:
    """The map place of a crop's corner."""
    return ox + rx * pw, oy - ry * F.abs(ph)


def _pixel_edges(box: Box, ox: Column, pw: Column, oy: Column, ph: Column) -> Box:
    """Left, top, right, bottom in pixels. Left, top and bottom are rounded down, right up: a bottom row may be lost."""
    return F.floor((box[0] - ox) / pw), F.floor((box[3] - oy) / ph), F.ceil((box[2] - ox) / pw), F.floor((box[1] - oy) / ph)


def library_region(box: Box, ox: Column, pw: Column, oy: Column, ph: Column) -> Box:
    """x, y, width, height, cut at 0 only."""
    x0, y0, x1, y1 = _pixel_edges(box, ox, pw, oy, ph)
    zero = F.lit(0).cast("long")
    return F.greatest(x0, zero), F.greatest(y0, zero), F.greatest(x1 - x0, zero), F.greatest(y1 - y0, zero)


def _inside(edges: Box, width: Column, height: Column) -> Box:
    """The corner is moved into the image; the size is not shortened by that, only cut at the far edges."""
    x0, y0, x1, y1 = edges
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    x, y = clamp(x0, zero, width - 1), clamp(y0, zero, height - 1)
    return x, y, F.least(F.greatest(x1 - x0, one), width - x), F.least(F.greatest(y1 - y0, one), height - y)


def same_crs_region(box: Box, ox: Column, pw: Column, oy: Column, ph: Column, width: Column, height: Column) -> Box:
    return _inside(_pixel_edges(box, ox, pw, oy, ph), width, height)


def mercator_region(box: Box, ox: Column, pw: Column, oy: Column, ph: Column, width: Column, height: Column, radius: Column | None = None) -> Box:
    """A box in degrees on an image in EPSG 3857. Without overlap: a square in the middle, of 2 radii or FALLBACK pixels."""
    west, south = box_mercator(box[0], box[1])
    east, north = box_mercator(box[2], box[3])
    edges = _pixel_edges((west, south, east, north), ox, pw, oy, ph)
    meets = (edges[0] < width) & (edges[2] >= 0) & (edges[1] < height) & (edges[3] >= 0)
    size = F.lit(FALLBACK).cast("long") if radius is None else F.coalesce(to_u32(radius * 2 / F.abs(pw)), F.lit(FALLBACK).cast("long"))
    middle = lambda n: F.greatest(F.floor(n / 2) - F.floor(size / 2), F.lit(0).cast("long"))
    aside = (middle(width), middle(height), F.least(size, width), F.least(size, height))
    return tuple(F.when(meets, a).otherwise(b) for a, b in zip(_inside(edges, width, height), aside, strict=True))


def estimated_region(box: Box, ox: Column, pw: Column, oy: Column, ph: Column, width: Column, height: Column, source: Column) -> Box:
    """Any other pair of systems: degrees become metres at the box's middle latitude, other units stay as they are."""
    across = F.cos(F.radians((box[1] + box[3]) / 2)) * DEGREE
    scaled = (box[0] * across, box[1] * DEGREE, box[2] * across, box[3] * DEGREE)
    moved = tuple(F.when(source == 4326, a).otherwise(b) for a, b in zip(scaled, box, strict=True))
    return same_crs_region(moved, ox, pw, oy, ph, width, height)


def region(box: Box, source: Column, target: Column, ox: Column, pw: Column, oy: Column, ph: Column, width: Column, height: Column, radius: Column | None = None) -> Box:
    """Pixels of a box in EPSG `source` on an image in EPSG `target`. Where the source, the target or the geotransform
    is null, the box's numbers are pixels."""
    raw = (to_u32(box[0]), to_u32(box[1]), to_u32(box[2] - box[0]), to_u32(box[3] - box[1]))
    same, merc, other = same_crs_region(box, ox, pw, oy, ph, width, height), mercator_region(box, ox, pw, oy, ph, width, height, radius), estimated_region(box, ox, pw, oy, ph, width, height, source)
    plain = source.isNull() | target.isNull() | ox.isNull() | width.isNull()
    return tuple(F.when(plain, p).when(source == target, a).when((source == 4326) & (target == 3857), b).otherwise(c) for p, a, b, c in zip(raw, same, merc, other, strict=True))


def describe_crs(epsg: Column) -> Column:
    text = epsg.cast("string")
    utm = lambda base, side: F.concat(F.lit("UTM Zone "), (epsg - base).cast("string"), F.lit(f"{side} (EPSG:"), text, F.lit(")"))
    return (
        F.when(epsg == 4326, "WGS 84 (EPSG:4326)")
        .when(epsg == 3857, "Web Mercator (EPSG:3857)")
        .when(epsg.between(32601, 32660), utm(32600, "N"))
        .when(epsg.between(32701, 32760), utm(32700, "S"))
        .otherwise(F.concat(F.lit("EPSG:"), text))
    )


def parse_crs(text: Column) -> Column:
    """EPSG number of "EPSG:n" or "n", in any case and with blanks around; anything else raises."""
    found = F.regexp_extract(F.upper(F.trim(text)), r"^(?:EPSG:)?\+?(\d{1,10})$", 1)
    return F.when(found != "", found.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no EPSG code: "), text)).cast("long"))
