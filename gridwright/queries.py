"""The registered raster queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright import schema
from gridwright.functions import codecs, colours, geo, names
from gridwright.operators import catalog, palette, pixels
from gridwright.sources import tiff, writers
from gridwright.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# --- relations of pixels, points, colours and tags over the tables


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events", "event_id", "value")
    return own.select((F.col("event_id") % 100).cast("int").alias("x"), F.floor(F.col("event_id") / 100).cast("int").alias("y"), F.least(F.lit(255), F.floor("value")).cast("int").alias("v"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return own.select((F.col("o_orderkey") % 100).cast("int").alias("x"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("y"), F.least(F.lit(255), F.floor(F.col("o_totalprice") / 2000)).cast("int").alias("v"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cells = own.select(F.posexplode("embedding").alias("x", "e"), F.col("vec_id").cast("int").alias("y"))
    return cells.select("x", "y", F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("v"))


def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region", "r_regionkey", "r_name").select((k * 60).cast("int").alias("value"), F.col("r_name").alias("label"), ((k * 50) % 256).cast("int").alias("r"), ((k * 90 + 17) % 256).cast("int").alias("g"), ((255 - k * 40) % 256).cast("int").alias("b"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 17) % 170 - 85).cast("double").alias("lat"))


TAG_CYCLE = (254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322, 33550, 33922, 34735, 34736, 42112, 42113)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = F.array(*map(F.lit, TAG_CYCLE))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.floor(k / 25).cast("int").alias("path"), (k % 25).cast("int").alias("seq"), F.get(cycle, (F.col("p_size") % len(TAG_CYCLE)).cast("int")).alias("tag"), ((k % 12) + 1).cast("int").alias("field_type"), k.alias("value"))


EVENTS = "(select cast(event_id % 100 as int) x, cast(event_id // 100 as int) y, cast(least(255, floor(value)) as int) v from events) p"
ORDERS = "(select cast(o_orderkey % 100 as int) x, cast(o_orderkey // 100 as int) y, cast(least(255, floor(o_totalprice / 2000)) as int) v from orders) p"
EMBEDDED = "(select cast(i - 1 as int) x, cast(vec_id as int) y, cast(floor((cast(embedding[i] as double) + 1) * 127.5) as int) v from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) i from embeddings)) p"
COLORMAP = "(select cast(r_regionkey * 60 as int) value, r_name label, cast(r_regionkey * 50 % 256 as int) r, cast((r_regionkey * 90 + 17) % 256 as int) g, cast((255 - r_regionkey * 40) % 256 as int) b from region)"
POINTS = "(select s_suppkey, cast(s_suppkey * 37 % 360 - 180 as double) lon, cast(s_suppkey * 17 % 170 - 85 as double) lat from supplier) p"
TAGS = f"(select cast(p_partkey // 25 as int) path, cast(p_partkey % 25 as int) seq, ([{', '.join(map(str, TAG_CYCLE))}])[p_size % {len(TAG_CYCLE)} + 1] tag, cast(p_partkey % 12 + 1 as int) field_type, p_partkey as value from part) t"


def _case(listed: dict[int, str], code: str, default: str) -> str:
    return f"case {code} " + " ".join(f"when {k} then '{v}'" for k, v in listed.items()) + f" else {default} end"


# --- scans and selections


@query(f"select x, y, v from {EVENTS}")
def pixel_scan(spark, sf_dir):
    return events(spark, sf_dir)


@query(f"select x, y, v from {EMBEDDED}")
def pixel_scan_arrays(spark, sf_dir):
    return embedded(spark, sf_dir)


@query(f"select x, y, v r, v g, v b from {EVENTS}")
def gray_to_rgb(spark, sf_dir):
    return pixels.grey_to_rgb(events(spark, sf_dir))


@query(f"select x, y, cast((v * 2126 + (255 - v) * 7152 + (v // 2) * 722) // 10000 as int) v from {EVENTS}")
def rgb_to_luma(spark, sf_dir):
    return pixels.rgb_to_grey(events(spark, sf_dir).select("x", "y", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.floor(F.col("v") / 2).alias("b")))


@query(f"select cast(x - 20 as int) x, cast(y - 5 as int) y, v from {EVENTS} where x >= 20 and x < 60 and y >= 5 and y < 45")
def crop_region(spark, sf_dir):
    return pixels.crop(events(spark, sf_dir), 20, 5, 40, 40)


@query(
    f"""with g as (select cast(floor((1215.0 - 1000) / 10) as bigint) x0, cast(floor((4985.0 - 5000) / -10) as bigint) y0, cast(ceil((1595.0 - 1000) / 10) as bigint) x1, cast(floor((4715.0 - 5000) / -10) as bigint) y1),
    r as (select greatest(0, least(x0, 99)) rx, greatest(0, least(y0, 99)) ry, x1 - x0 w, y1 - y0 h from g)
    select cast(x - rx as int) x, cast(y - ry as int) y, v from {ORDERS}, r where x >= rx and x < rx + w and y >= ry and y < ry + h"""
)
def crop_bbox_same_crs(spark, sf_dir):
    box = tuple(F.lit(float(v)) for v in (1215, 4715, 1595, 4985))
    found = geo.same_crs_region(box, F.lit(1000.0), F.lit(10.0), F.lit(5000.0), F.lit(-10.0), F.lit(100).cast("long"), F.lit(100).cast("long"))
    return pixels.crop(orders(spark, sf_dir), *found)


@query(f"select x, y, cast(case when v between 40 and 120 then v else 0 end as int) v from {EVENTS}")
def value_filter_opaque(spark, sf_dir):
    return pixels.value_filter(events(spark, sf_dir), *pixels.parse_range("40,120"))


@query(f"select x, y, case when k then v else 0 end r, case when k then v else 0 end g, case when k then v else 0 end b, cast(case when k then 255 else 0 end as int) a from (select *, v between 40 and 120 k from {EVENTS})")
def value_filter_alpha(spark, sf_dir):
    return pixels.value_filter_alpha(events(spark, sf_dir), 40, 120)


@query(f"select x, y, case when k then v else 0 end r, case when k then v else 0 end g, case when k then v else 0 end b, cast(case when k then 255 else 0 end as int) a from (select *, (2 * x - 99) * (2 * x - 99) + (2 * y - 100) * (2 * y - 100) <= 98 * 98 k from {EVENTS} where x < 99 and y < 100)")
def circle_mask(spark, sf_dir):
    window = pixels.crop(events(spark, sf_dir), 0, 0, 99, 100)
    return pixels.circle_mask(pixels.grey_to_rgb(window), 99, 100)


@query(f"select coalesce(min(v), 255) min_value, coalesce(max(v), 0) max_value from {EVENTS}")
def stats_gray(spark, sf_dir):
    return pixels.grey_stats(events(spark, sf_dir))


@query(f"select 255 min_value, 0 max_value from (select count(*) n from {EVENTS} where v < 0)")
def stats_gray_empty(spark, sf_dir):
    return pixels.grey_stats(events(spark, sf_dir).where("v < 0"))


@query(f"select min(v) min_r, max(v) max_r, min(255 - v) min_g, max(255 - v) max_g, min(v // 2) min_b, max(v // 2) max_b, least(min(v), min(255 - v), min(v // 2)) min_value, greatest(max(v), max(255 - v), max(v // 2)) max_value from {ORDERS}")
def stats_rgb(spark, sf_dir):
    return pixels.rgb_stats(orders(spark, sf_dir).select("x", "y", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.floor(F.col("v") / 2).cast("int").alias("b")))


@query(f"select x, y, cast((v - coalesce(lag(v) over (partition by y order by x), 0) + 256) % 256 as int) v from {EVENTS}")
def predictor_encode(spark, sf_dir):
    return pixels.predictor_encode(events(spark, sf_dir))


@query(f"select x, y, v from {EVENTS}")
def predictor_decode(spark, sf_dir):
    return pixels.predictor_decode(pixels.predictor_encode(events(spark, sf_dir)))


@query(f"select cast(x // 16 as int) bx, cast(y // 16 as int) \"by\", count(*) n, min(v) lo, max(v) hi from {ORDERS} group by 1, 2")
def block_grid(spark, sf_dir):
    return pixels.block_grid(orders(spark, sf_dir), 16, 16)


@query(f"select cast(x // 16 as int) bx, cast(y // 16 as int) \"by\", count(*) n from {ORDERS} where x // 16 * 16 < 50 and y // 16 * 16 < 35 and x // 16 * 16 + 16 > 20 and y // 16 * 16 + 16 > 5 group by 1, 2")
def block_prune(spark, sf_dir):
    grid = pixels.block_grid(orders(spark, sf_dir), 16, 16)
    placed = grid.withColumns({"x0": F.col("bx") * 16, "y0": F.col("by") * 16, "w": F.lit(16), "h": F.lit(16)})
    return pixels.blocks_of_region(placed, 20, 5, 30, 30).select("bx", "by", "n")


@query(f"select y, concat(cast(y as varchar), ',', string_agg(cast(v as varchar), ',' order by x)) line from {EVENTS} group by y")
def array_csv_rows(spark, sf_dir):
    return pixels.csv_rows(events(spark, sf_dir))


@query(f"select y, concat('    [', string_agg(cast(v as varchar), ', ' order by x), ']') line from {EVENTS} group by y")
def array_json_rows(spark, sf_dir):
    return pixels.json_rows(events(spark, sf_dir))


@query(f"select y, max(case when x = 37 then v end) v from {EVENTS} where y = 4 group by y")
def array_get(spark, sf_dir):
    return pixels.value_at(pixels.rows_of(events(spark, sf_dir)), F.lit(37), F.lit(4))


# --- colours

LUT = f"""with c as {COLORMAP[0:-1]}), d as (select cast(range as int) v from range(256)),
 s as (select d.v, (select max(value) from c where value <= d.v) lo, (select min(value) from c where value >= d.v) hi from d),
 j as (select s.v, a.value av, a.r ar, a.g ag, a.b ab, b.value bv, b.r br, b.g bg, b.b bb from s left join c a on a.value = s.lo left join c b on b.value = s.hi)"""
_RAMP = "cast(case when v = 255 then 255 when av is null then b{0} when bv is null then a{0} when av = bv then a{0} else trunc(cast(a{0} as float) * (cast(1 as float) - cast(v - av as float) / cast(bv - av as float)) + cast(b{0} as float) * (cast(v - av as float) / cast(bv - av as float))) end as int)"
_NEAR = "cast(case when v = 255 then 255 when av is null then b{0} when bv is null then a{0} when v - av <= bv - v then a{0} else b{0} end as int)"
RAMP = ", ".join(f"{_RAMP.format(c)} {c}" for c in "rgb")
NEAR = ", ".join(f"{_NEAR.format(c)} {c}" for c in "rgb")


@query(f"{LUT} select v, {RAMP} from j")
def colormap_lut_ramp(spark, sf_dir):
    return palette.lookup_table(colormap(spark, sf_dir), "ramp")


@query(f"{LUT} select v, {NEAR} from j")
def colormap_lut_nearest(spark, sf_dir):
    return palette.lookup_table(colormap(spark, sf_dir), "intervals")


@query(f"{LUT}, l as (select v, {RAMP} from j) select x, y, r, g, b from {EVENTS} join l using (v)")
def colormap_apply(spark, sf_dir):
    return palette.apply_colormap(events(spark, sf_dir), colormap(spark, sf_dir))


@query(f"{LUT}, l as (select v, {RAMP} from j) select x, y, r, g, b from (select x, y, cast(case when v between 40 and 120 then v else 0 end as int) v from {EVENTS}) join l using (v)")
def colormap_filter_then_apply(spark, sf_dir):
    filtered = pixels.value_filter_alpha(events(spark, sf_dir), 40, 120)  # the colours' grey again: alpha is lost
    return palette.apply_colormap(pixels.rgb_to_grey(filtered), colormap(spark, sf_dir))


@query(f"select max_value, cast(greatest(1, length(bin(max_value))) as int) bits, cast(1 << greatest(1, length(bin(max_value))) as bigint) size from (select cast(max(value) as bigint) max_value from {COLORMAP})")
def palette_size(spark, sf_dir):
    return palette.palette_size(colormap(spark, sf_dir))


_STEP = "cast(coalesce(case when b.value = a.value then a.{0} * 257 else a.{0} * 257 + floor((b.{0} * 257 - a.{0} * 257) * (d.v - a.value) / (b.value - a.value)) end, 0) as int) {0}"


@query(f"with c as {COLORMAP}, d as (select cast(range as int) v from range(256)), s as (select d.v, (select max(value) from c where value <= d.v) lo, (select min(value) from c where value >= d.v) hi from d) select d.v, {', '.join(_STEP.format(c) for c in 'rgb')} from s d left join c a on a.value = d.lo and d.hi is not null left join c b on b.value = d.hi and d.lo is not null")
def palette_from_colormap(spark, sf_dir):
    return palette.palette_table(colormap(spark, sf_dir), 256)


@query(f"with t as (select distinct cast(v as int) as value, cast(v // 40 * 40 as int) r, cast(v // 80 * 80 as int) g, 0 b from {EVENTS}) select min(value) as value, r, g, b from t group by r, g, b")
def palette_dedupe(spark, sf_dir):
    own = events(spark, sf_dir).select(F.col("v").alias("value"), (F.floor(F.col("v") / 40) * 40).cast("int").alias("r"), (F.floor(F.col("v") / 80) * 80).cast("int").alias("g"), F.lit(0).alias("b"))
    return palette.distinct_colours(own)


@query(f"with t as (select distinct v as value, cast(greatest(0, v - 30) as int) r, 0 g, 0 b from {EVENTS}) select value, r, g, b from t where value >= (select min(value) from t where r + g + b > 0)")
def palette_strip_black(spark, sf_dir):
    own = events(spark, sf_dir).select(F.col("v").alias("value"), F.greatest(F.lit(0), F.col("v") - 30).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")).distinct()
    return palette.strip_leading_black(own)


@query("select p_partkey, printf('#%02x%02x%02x', p_partkey % 256, p_size * 5 % 256, p_partkey * 7 % 256) hex from part")
def hex_encode(spark, sf_dir):
    own = table(spark, sf_dir, "part", "p_partkey", "p_size")
    return own.select("p_partkey", colours.hex_encode(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256).alias("hex"))


@query("select p_partkey, cast(p_partkey % 256 as int) r, cast(p_size * 5 % 256 as int) g, cast(p_partkey * 7 % 256 as int) b from part")
def hex_decode(spark, sf_dir):
    own = table(spark, sf_dir, "part", "p_partkey", "p_size")
    text = F.concat(F.lit("##"), F.substring(colours.hex_encode(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256), 2, 6))
    return own.select("p_partkey", colours.hex_decode(text).alias("c")).select("p_partkey", "c.*")


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;')"


@query(f"""select value, concat('              <sld:ColorMapEntry quantity="', value, '" label="', {_ESCAPED.format('label')}, '" color="', printf('#%02x%02x%02x', r, g, b), '"/>') line from {COLORMAP}""")
def sld_rows(spark, sf_dir):
    return palette.sld_lines(colormap(spark, sf_dir))


@query(f"select value, label, r, g, b from {COLORMAP}")
def sld_parse(spark, sf_dir):
    return palette.parse_sld_lines(palette.sld_lines(colormap(spark, sf_dir)).select("line"))


@query(f"select value, case when value % 120 = 0 then label end label, r, g, b from {COLORMAP}")
def colormap_csv_parse(spark, sf_dir):
    own = colormap(spark, sf_dir)
    as_hex = F.concat_ws(", ", F.col("value").cast("string"), colours.hex_encode(F.col("r"), F.col("g"), F.col("b")))
    as_bytes = F.concat_ws(",", *(F.col(c).cast("string") for c in ("value", "r", "g", "b")), "label")
    lines = own.select(F.explode(F.array(F.lit("# note"), F.lit(" "), F.when(F.col("value") % 120 == 0, as_bytes).otherwise(as_hex), F.lit("7"))).alias("line"))
    return palette.parse_csv_lines(lines)


# --- coordinates

R = "6378137.0"


def _rounded(*columns) -> list:
    return [(F.round(c, 6) + 0.0).alias(n) for n, c in columns]


_MERC = f"round(lon * pi() / 180 * {R}, 6) + 0.0 x, round(ln(tan((90 + greatest(-85.05, least(85.05, lat))) * pi() / 360)) * {R}, 6) + 0.0 y"


@query(f"select s_suppkey, {_MERC} from {POINTS}")
def wgs84_to_mercator(spark, sf_dir):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("s_suppkey", *_rounded(("x", x), ("y", y)))


@query(f"select s_suppkey, round(lon * 100000 / {R} * 180 / pi(), 6) lon, round(degrees(2 * atan(exp(lat * 100000 / {R})) - pi() / 2), 6) lat from {POINTS}")
def mercator_to_wgs84(spark, sf_dir):
    lon, lat = geo.unmercator(F.col("lon") * 100000, F.col("lat") * 100000)
    return points(spark, sf_dir).select("s_suppkey", *_rounded(("lon", lon), ("lat", lat)))


@query(f"select s_suppkey, case when s_suppkey % 2 = 0 then x else lon end x, case when s_suppkey % 2 = 0 then y else lat end y from (select s_suppkey, lon, lat, {_MERC} from {POINTS})")
def transform_point(spark, sf_dir):
    target = F.when(F.col("s_suppkey") % 2 == 0, 3857).otherwise(4326)
    x, y = geo.transform(F.col("lon"), F.col("lat"), F.lit(4326), target)
    return points(spark, sf_dir).select("s_suppkey", *_rounded(("x", x), ("y", y)))


_HALF = "5000 / (111320.0 * cos(lat * pi() / 180))"


@query(f"select s_suppkey, round(lon - {_HALF}, 6) min_x, round(lat - 5000 / 111320.0, 6) min_y, round(lon + {_HALF}, 6) max_x, round(lat + 5000 / 111320.0, 6) max_y from {POINTS}")
def point_buffer(spark, sf_dir):
    box = geo.buffer(F.col("lon"), F.col("lat"), F.lit(5000.0), F.lit(4326))
    return points(spark, sf_dir).select("s_suppkey", *_rounded(*zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True)))


_EPSG = "(case s_suppkey % 3 when 0 then 3857 when 1 then 4326 else 32633 end)"
_P = "radians(abs(lat))"
_MPD = f"((111132.92 - 559.82 * cos(2 * {_P}) + 1.175 * cos(4 * {_P}) + 111412.84 * cos({_P}) - 93.5 * cos(3 * {_P})) / 2)"
_DX = f"(case s_suppkey % 3 when 0 then 1000.0 when 1 then 1000.0 / (111320.0 * cos(radians(lat))) else 1000.0 / {_MPD} end)"
_DY = f"(case s_suppkey % 3 when 0 then 1000.0 when 1 then 1000.0 / 111320.0 else 1000.0 / {_MPD} end)"


@query(f"select s_suppkey, round(lon - {_DX}, 6) min_x, round(lat - {_DY}, 6) min_y, round(lon + {_DX}, 6) max_x, round(lat + {_DY}, 6) max_y from {POINTS}")
def coord_radius_bbox(spark, sf_dir):
    epsg = F.when(F.col("s_suppkey") % 3 == 0, 3857).when(F.col("s_suppkey") % 3 == 1, 4326).otherwise(32633)
    text = F.concat_ws(", ", F.col("lon").cast("string"), F.col("lat").cast("string"))
    own = points(spark, sf_dir).withColumn("c", geo.parse_numbers(text, "x y"))
    box = geo.radius_box(F.col("c.x"), F.col("c.y"), F.lit(1000.0), epsg)
    return own.select("s_suppkey", *_rounded(*zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True)))


@query(f"select s_suppkey, 20.0::double width, 10.0::double height, lon + 10 center_x, lat + 5 center_y, (lon between lon and lon + 20 and 0 between lat and lat + 10) inside from {POINTS}")
def bbox_parse_measure(spark, sf_dir):
    text = F.concat_ws(",", *(c.cast("string") for c in (F.col("lon"), F.col("lat"), F.col("lon") + 20, F.col("lat") + 10)))
    own = points(spark, sf_dir).withColumn("b", geo.parse_numbers(text, "x0 y0 x1 y1"))
    box = tuple(F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1"))
    return own.select("s_suppkey", *(c.alias(n) for n, c in zip(("width", "height", "center_x", "center_y"), geo.box_size(box), strict=True)), geo.box_contains(box, F.col("lon"), F.lit(0.0)).alias("inside"))


def _region_sql(x0: str, y0: str, x1: str, y1: str, source: str, miss: bool) -> str:
    """x0.. are edges in map units; the image has origin (-12200000, 7620000), pixels of 30000, 800 by 400."""
    edges = f"select s_suppkey, cast(floor(({x0} + 12200000) / 30000) as bigint) x0, cast(floor(({y1} - 7620000) / -30000) as bigint) y0, cast(ceil(({x1} + 12200000) / 30000) as bigint) x1, cast(floor(({y0} - 7620000) / -30000) as bigint) y1 from {source}"
    inside = "greatest(0, least(x0, 799)) x, greatest(0, least(y0, 399)) y, least(greatest(x1 - x0, 1), 800 - greatest(0, least(x0, 799))) width, least(greatest(y1 - y0, 1), 400 - greatest(0, least(y0, 399))) height"
    if not miss:
        return f"select s_suppkey, {inside} from ({edges})"
    meets = "x0 < 800 and x1 >= 0 and y0 < 400 and y1 >= 0"
    return f"select s_suppkey, case when m then x else 0 end x, case when m then y else 0 end y, case when m then width else 800 end width, case when m then height else 400 end height from (select s_suppkey, {meets} m, {inside} from ({edges}))"


def _boxes(spark, sf_dir):
    lon, lat = F.col("lon") + 0.123, F.col("lat") + 0.321
    return points(spark, sf_dir), (lon, lat, lon + 7.77, lat + 5.55)



def _image():
    return (*(F.lit(v) for v in (-12200000.0, 30000.0, 7620000.0, -30000.0)), F.lit(800).cast("long"), F.lit(400).cast("long"))


_BOXED = f"(select s_suppkey, lon + 0.123 a, lat + 0.321 b, lon + 0.123 + 7.77 c, lat + 0.321 + 5.55 d from {POINTS})"
_MX, _MY = "({0} * 20037508.34 / 180)", "(ln(tan((90 + greatest(-85.06, least(85.06, {0}))) * pi() / 360)) * 20037508.34 / pi())"


@query(_region_sql(_MX.format("a"), _MY.format("b"), _MX.format("c"), _MY.format("d"), _BOXED, True))
def bbox_to_region_wgs84_mercator(spark, sf_dir):
    own, box = _boxes(spark, sf_dir)
    found = geo.mercator_region(box, *_image())
    return own.select("s_suppkey", *(c.alias(n) for n, c in zip(("x", "y", "width", "height"), found, strict=True)))


_K = "(111320.0 * cos((b + d) / 2 * pi() / 180))"


@query(_region_sql(f"(a * {_K})", "(b * 111320.0)", f"(c * {_K})", "(d * 111320.0)", _BOXED, False))
def bbox_to_region_generic(spark, sf_dir):
    own, box = _boxes(spark, sf_dir)
    found = geo.region(box, F.lit(4326), F.lit(32633), *_image())
    return own.select("s_suppkey", *(c.alias(n) for n, c in zip(("x", "y", "width", "height"), found, strict=True)))


@query(_region_sql("(a * 100000)", "(b * 100000)", "(c * 100000)", "(d * 100000)", _BOXED, False))
def bbox_to_region_same_crs(spark, sf_dir):
    own, box = _boxes(spark, sf_dir)
    found = geo.region(tuple(c * 100000 for c in box), F.lit(3857), F.lit(3857), *_image())
    return own.select("s_suppkey", *(c.alias(n) for n, c in zip(("x", "y", "width", "height"), found, strict=True)))


@query(f"select s_suppkey, greatest(0, x0) x, greatest(0, y0) y, greatest(0, x1 - x0) width, greatest(0, y1 - y0) height from ({_region_sql('(a * 100000)', '(b * 100000)', '(c * 100000)', '(d * 100000)', _BOXED, False).split(' from (', 1)[1][:-1]})")
def bbox_to_region_library(spark, sf_dir):
    own, box = _boxes(spark, sf_dir)
    found = geo.library_region(tuple(c * 100000 for c in box), *_image()[:4])
    return own.select("s_suppkey", *(c.alias(n) for n, c in zip(("x", "y", "width", "height"), found, strict=True)))


def _tied(spark, sf_dir):
    """Points as tie points of images: raster place 2, 3 ties to lon, lat; pixels of 0.5 by 0.25 degrees."""
    tie = F.array(F.lit(2.0), F.lit(3.0), F.lit(0.0), F.col("lon"), F.col("lat"), F.lit(0.0))
    return points(spark, sf_dir), geo.geotransform(tie, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.0)))


@query(f"select s_suppkey, lon - 1 ox, 0.5::double pw, lat + 0.75 oy, -0.25::double ph from {POINTS}")
def geotransform(spark, sf_dir):
    own, g = _tied(spark, sf_dir)
    return own.select("s_suppkey", *(c.alias(n) for n, c in zip(("ox", "pw", "oy", "ph"), g, strict=True)))


@query(f"select s_suppkey, lon - 1 min_x, lat + 0.75 - 20 min_y, lon - 1 + 50 max_x, lat + 0.75 max_y from {POINTS}")
def raster_bounds(spark, sf_dir):
    own, g = _tied(spark, sf_dir)
    box = geo.raster_bounds(*g, F.lit(100), F.lit(80))
    return own.select("s_suppkey", *(c.alias(n) for n, c in zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True)))


@query(f"select s_suppkey, lon - 1 + 10 * 0.5 ox, lat + 0.75 - 12 * 0.25 oy from {POINTS}")
def crop_georef_shift(spark, sf_dir):
    own, g = _tied(spark, sf_dir)
    x, y = geo.shifted_origin(*g, F.lit(10), F.lit(12))
    return own.select("s_suppkey", x.cast("double").alias("ox"), y.cast("double").alias("oy"))


# --- names and catalogue

_CODE = "(case when p_partkey % 4 = 0 then 32600 + p_size when p_partkey % 4 = 1 then 32700 + p_size when p_partkey % 4 = 2 then 4326 - p_size % 3 * 469 else 2000 + p_size * 30 end)"


def _codes(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    code = F.when(k % 4 == 0, n + 32600).when(k % 4 == 1, n + 32700).when(k % 4 == 2, 4326 - n % 3 * 469).otherwise(2000 + n * 30)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", code.cast("int").alias("code"))


@query(f"select p_partkey, case when code = 4326 then 'WGS 84 (EPSG:4326)' when code = 3857 then 'Web Mercator (EPSG:3857)' when code between 32601 and 32660 then concat('UTM Zone ', code - 32600, 'N (EPSG:', code, ')') when code between 32701 and 32760 then concat('UTM Zone ', code - 32700, 'S (EPSG:', code, ')') else concat('EPSG:', code) end name from (select p_partkey, {_CODE} code from part)")
def crs_describe(spark, sf_dir):
    own = _codes(spark, sf_dir)
    return own.select("p_partkey", geo.describe_crs(geo.parse_crs(F.concat(F.lit(" epsg:"), F.col("code").cast("string")))).alias("name"))


_LISTED = " ".join(f"when code between {a} and {b} then " + (f"'{t}'" if off is None else f"concat('{t.partition('{}')[0]}', code - {off}, '{t.partition('{}')[2]}')") for a, b, t, off in names.PROJECTED)


@query(f"select p_partkey, case {_LISTED} else concat('EPSG:', code) end name from (select p_partkey, {_CODE} code from part)")
def projected_cs_describe(spark, sf_dir):
    return _codes(spark, sf_dir).select("p_partkey", names.describe_projected(F.col("code")).alias("name"))


@query(f"select p_partkey, case when e = 3857 then 'Web Mercator (EPSG:3857)' when e = 4326 then 'WGS84 Geographic (EPSG:4326)' when e > 0 then concat('EPSG:', e) when m > 0 then {_case(names.METHODS, 'm', chr(39) + chr(39))} || case when m in (1, 9, 10, 11) then '' else concat('Projection code: ', m) end when g > 0 then concat('Geographic CS: ', g) else 'Unknown projection' end name from (select p_partkey, case p_partkey % 5 when 0 then 3857 when 1 then 4326 when 2 then 32600 + p_size else 0 end e, case when p_partkey % 5 = 3 then p_size % 14 else 0 end m, p_size % 2 * 4326 g from part)")
def projection_string(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_size")
    epsg = F.when(k == 0, 3857).when(k == 1, 4326).when(k == 2, n + 32600).otherwise(0)
    method = F.when(k == 3, n % 14).otherwise(0)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", names.describe_projection(epsg, method, n % 2 * 4326).alias("name"))


@query(f"select p_partkey, {_case(names.COMPRESSIONS, 'p_size % 16', chr(39) + 'Unknown' + chr(39))} short_name, {_case(names.COMPRESSIONS_LONG, 'p_size % 16', chr(39) + 'Unknown' + chr(39))} long_name from part")
def compression_name(spark, sf_dir):
    code = F.col("p_size") % 16
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", names.compression_name(code).alias("short_name"), names.compression_name(code, long=True).alias("long_name"))


_U = "'Unknown'"


@query(f"select p_partkey, {_case(names.PHOTOMETRICS, 'p_size % 10', _U)} photometric, {_case(names.PHOTOMETRICS_LONG, 'p_size % 10', _U)} photometric_long, {_case(names.SAMPLE_FORMATS, 'p_size % 8', _U)} sample_format, {_case(names.PREDICTORS, 'p_size % 5', _U)} predictor, {_case(names.PLANARS, 'p_size % 4', _U)} planar from part")
def layout_names(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        "p_partkey", names.photometric_name(n % 10).alias("photometric"), names.photometric_name(n % 10, long=True).alias("photometric_long"),
        names.sample_format_name(n % 8).alias("sample_format"), names.predictor_name(n % 5).alias("predictor"), names.planar_name(n % 4).alias("planar"),
    )


@query(f"select path, seq, {_case(names.TAG_NAMES, 'tag', _U)} tag_name, {_case(names.FIELD_TYPES, 'field_type', _U)} type_name from {TAGS}")
def tag_name(spark, sf_dir):
    return catalog.describe_tags(tags(spark, sf_dir)).select("path", "seq", "tag_name", "type_name")


@query(f"select path, seq, {_case(names.GEO_TAGS, 'tag', 'concat(' + chr(39) + 'Unknown-' + chr(39) + ', tag)')} tag_name, {_case(names.GEO_KEYS, '(1020 + seq)', 'concat(' + chr(39) + 'Unknown-' + chr(39) + ', 1020 + seq)')} key_name from {TAGS}")
def geo_names(spark, sf_dir):
    return tags(spark, sf_dir).select("path", "seq", names.geo_tag_name(F.col("tag")).alias("tag_name"), names.geo_key_name(F.col("seq") + 1020).alias("key_name"))


@query(f"select p_partkey, {_case(names.CODES['linear_unit'], '(9000 + p_size)', 'cast(9000 + p_size as varchar)')} name from part")
def code_name(spark, sf_dir):
    own = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("code", F.col("p_size") + 9000)
    return names.name_codes(own, names.code_table(spark), "linear_unit", "code", "name").select("p_partkey", "name")


@query(f"select path, seq, value from {TAGS} where tag = 254 and value % 2 = 1")
def overview_filter(spark, sf_dir):
    return catalog.overviews(tags(spark, sf_dir).where("tag = 254").withColumn("subfile", F.col("value").cast("int"))).select("path", "seq", "value")


@query(f"select path, seq, tag from {TAGS} where tag in ({', '.join(map(str, names.GEOTIFF_TAGS))})")
def geotiff_tag_filter(spark, sf_dir):
    return catalog.geotiff_tags(tags(spark, sf_dir)).select("path", "seq", "tag")


@query(f"select path, count(*) entries, max(case when tag = 256 then value end) width, max(case when tag = 257 then value end) height, coalesce(max(case when tag = 277 then value end), 1) samples from {TAGS} group by path")
def ifd_summary(spark, sf_dir):
    of = lambda t: F.max(F.when(F.col("tag") == t, F.col("value")))
    return tags(spark, sf_dir).groupBy("path").agg(F.count("*").alias("entries"), of(256).alias("width"), of(257).alias("height"), F.coalesce(of(277), F.lit(1)).alias("samples"))


@query(f"select path, seq, tag, value from {TAGS} qualify row_number() over (partition by path, tag order by seq desc) = 1")
def tag_dedupe_last_wins(spark, sf_dir):
    return catalog.last_wins(tags(spark, sf_dir)).select("path", "seq", "tag", "value")


@query(f"select path, seq, tag from {TAGS} where tag not in ({', '.join(map(str, catalog.LAYOUT_TAGS))})")
def tag_copy_except(spark, sf_dir):
    return catalog.copy_except(tags(spark, sf_dir)).select("path", "seq", "tag")


@query(f"select path, seq, tag, cast(row_number() over (partition by path order by tag, seq) as int) rank from {TAGS} qualify rank <= 10")
def tag_top10(spark, sf_dir):
    return catalog.first_tags(tags(spark, sf_dir)).select("path", "seq", "tag", "rank")


@query(f"select path, seq, o.value off, n.value size from (select path, row_number() over (partition by path order by seq) - 1 seq, value from {TAGS} where tag = 273) o join (select path, row_number() over (partition by path order by seq) - 1 seq, value from {TAGS} where tag = 279) n using (path, seq)")
def tag_zip_offsets(spark, sf_dir):
    listed = tags(spark, sf_dir).groupBy("path").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.struct("seq", "value")))), lambda x: x["value"]).alias(n) for t, n in ((273, "off"), (279, "size"))))
    both = listed.select("path", F.posexplode(F.arrays_zip("off", "size")).alias("seq", "z")).where("z.off is not null and z.size is not null")
    return both.select("path", F.col("seq").cast("long").alias("seq"), "z.off", "z.size")


@query("select p_partkey, case trim(t) when '' then '255' when ':w' then '255' else trim(t) end nodata from (select p_partkey, case p_partkey % 4 when 0 then ' :w ' when 1 then '' when 2 then concat(' ', p_size, ' ') else '-9999' end t from part)")
def nodata_normalise(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, " :w ").when(k == 1, "").when(k == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).otherwise("-9999")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", colours.nodata_text(text).alias("nodata"))


_ITEM = "concat('<Item name=\"NODATA_VALUES\">', p_size, '</Item>')"


@query(f"select p_partkey, case p_partkey % 3 when 0 then concat('<GDALMetadata>' || chr(10) || '  ', {_ITEM}, chr(10) || '</GDALMetadata>') when 1 then concat('<GDALMetadata><Item name=\"A\">', p_name, '</Item>  ', {_ITEM}, chr(10) || '</GDALMetadata>') else concat('<GDALMetadata>', {_ITEM}, '<Item name=\"B\">x</Item></GDALMetadata>') end xml from part")
def gdal_metadata_upsert(spark, sf_dir):
    k = F.col("p_partkey") % 3
    old = F.when(k == 1, F.concat(F.lit('<GDALMetadata><Item name="A">'), F.col("p_name"), F.lit("</Item></GDALMetadata>"))).when(k == 2, F.lit('<GDALMetadata><Item name="NODATA_VALUES" sample="0">77</Item><Item name="B">x</Item></GDALMetadata>'))
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_name").select("p_partkey", colours.with_nodata_item(old, F.col("p_size").cast("string")).alias("xml"))


# --- blocks and files made of the pixels, 100 wide


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Uncompressed blocks of so many rows, as the source gives them; a block is a group."""

    def block(key, group):
        import numpy as np
        import pyarrow as pa

        y0 = key[0].as_py() * rows
        x, y, v = (group.column(c).to_numpy() for c in ("x", "y", "v"))
        data = np.zeros((int(y.max()) - y0 + 1, 100), np.uint8)
        data[y - y0, x] = v
        row = {"path": "made", "ifd_no": 0, "block_no": key[0].as_py(), "bx": 0, "by": key[0].as_py(), "x0": 0, "y0": y0, "w": 100, "h": len(data), "stride": 100, "compression": 1, "predictor": 1, "offset": 0, "byte_count": data.size, "data": data.tobytes()}
        return pa.Table.from_pylist([row], pa.schema(tiff._arrow("blocks")))

    return df.groupBy(F.floor(F.col("y") / rows).cast("int").alias("by")).applyInArrow(block, schema.BLOCKS)


@query(f"select x, y, v from {EVENTS}")
def codec_roundtrip_deflate(spark, sf_dir):
    return codecs.to_pixels(codecs.transcode(_packed(events(spark, sf_dir), 16), 8)).select("x", "y", "v")


@query(f"select x, y, v from {EVENTS}")
def codec_roundtrip_zstd(spark, sf_dir):
    return codecs.to_pixels(codecs.transcode(codecs.transcode(_packed(events(spark, sf_dir), 16), 8), 14)).select("x", "y", "v")


@query(f"select x, y, v from {EVENTS}")
def tiff_roundtrip(spark, sf_dir):
    """TIFF files of 250 rows each, made in the tasks, and read again as files are."""

    def made(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                out, data = io.BytesIO(), np.frombuffer(r["data"], np.uint8).reshape(-1, 100)
                writers.write_image(out, (row.tobytes() for row in data), 100, len(data), 1, encode=codecs.codec(8).encode, compression=8)
                rows.append((str(r["block_no"]), len(out.getvalue()), out.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["path", "length", "content"])

    files = _packed(events(spark, sf_dir), 250).mapInArrow(made, schema.FILES)
    return watch.pixels(files).where("error is null").select("x", (F.col("y") + F.col("path").cast("int") * 250).alias("y"), "v")
