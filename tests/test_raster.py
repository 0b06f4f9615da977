import io
import itertools
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright import errors
from gridwright.functions import codecs, colours, geo, names
from gridwright.operators import palette, pixels
from gridwright.plans.engine import RasterEngine, with_epsg
from gridwright.sources import colormaps, tiff, writers


def image(w=50, h=37, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w), np.uint8)


KEYS_3857 = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 3857]
KEYS_4326 = [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326]


def make(v, order="<", big=False, tile=None, rows=10, compression=1, predictor=1, more=None, overview=None, keys=None, scale=(10.0, 10.0, 0.0), tie=(0.0, 0.0, 0.0, 1000.0, 5000.0, 0.0)):
    """A TIFF built by hand, of either byte order; overview: a second directory."""
    out = bytearray(struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 0) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link, wide, room = (8, "Q", 8) if big else (4, "I", 4)
    for level, own in enumerate([v] if overview is None else [v, overview]):
        h, w = own.shape
        if tile:
            boxes = [(y, x, tile, tile) for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            boxes = [(y, 0, min(rows, h - y), w) for y in range(0, h, rows)]
        placed = []
        for y, x, bh, bw in boxes:
            block = np.zeros((bh, bw), np.uint8)
            part = own[y : y + bh, x : x + bw]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((bh, 1), np.uint8)).astype(np.uint8)
            data = codecs.codec(compression).encode(block.tobytes())
            placed.append((len(out), len(data)))
            out += data
        tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [8]), 259: (3, [compression]), 262: (3, [1]), 277: (3, [1]), 317: (3, [predictor]), 305: (2, b"made by hand\0")}
        tags |= {322: (4, [tile]), 323: (4, [tile]), 324: (4, [o for o, _ in placed]), 325: (4, [n for _, n in placed])} if tile else {273: (4, [o for o, _ in placed]), 278: (4, [rows]), 279: (4, [n for _, n in placed])}
        if keys:
            tags |= {33550: (12, list(scale)), 33922: (12, list(tie)), 34735: (3, keys)}
        if level:
            tags[254] = (4, [1])
        body = b""
        for tag, (kind, values) in sorted((tags | (more or {})).items()):
            raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{tiff.CODES[kind]}", *values)
            n = len(values)
            if len(raw) > room:
                out += bytes(-len(out) % 2)
                at = len(out)
                out += raw
                raw = struct.pack(order + wide, at)
            body += struct.pack(order + "HH" + wide, tag, kind, n) + raw.ljust(room, b"\0")
        at = len(out)
        count = len(tags | (more or {}))
        out += struct.pack(order + ("Q" if big else "H"), count) + body
        out[link : link + room] = struct.pack(order + wide, at)
        link = len(out)
        out += bytes(room)
    return bytes(out)


@pytest.fixture(scope="module")
def engine(spark):
    return RasterEngine(spark)


def grid(df, w, h):
    out = np.zeros((h, w), int)
    rows = df.collect()
    assert len(rows) == w * h
    for r in rows:
        out[r["y"], r["x"]] = r["v"]
    return out


MATRIX = [c for i, c in enumerate(itertools.product("<>", (False, True), (None, 16), (1, 8, 14), (1, 2))) if i % 5 == 0]


@pytest.mark.parametrize("order,big,tile,compression,predictor", MATRIX)
def test_read_matrix(engine, tmp_path, order, big, tile, compression, predictor):
    v = image()
    path = str(tmp_path / "a.TIF")
    with open(path, "wb") as f:
        f.write(make(v, order, big, tile, 10, compression, predictor))
    assert (grid(engine.pixels(path), 50, 37) == v).all()
    assert (grid(engine.pixels(path, (7, 11, 20, 13)), 20, 13) == v[11:24, 7:27]).all()


def test_header_reading():
    for order, big in itertools.product("<>", (False, True)):
        data = make(image(), order, big, overview=image(20, 10), keys=KEYS_3857, more={42113: (2, b"17\0"), 282: (5, struct.pack(order + "2I", 72, 2))})
        ifds = tiff.read_ifds(tiff.Bytes(io.BytesIO(data), len(data)))
        assert [i.one(256) for i in ifds] == [50, 20] and [i.one(254, 0) for i in ifds] == [0, 1]
        assert ifds[0].text(42113) == "17" and ifds[0].text(305) == "made by hand"
        assert ifds[0].geokey(3072) == 3857 and ifds[0].doubles(33550) == [10, 10, 0]
        assert ifds[0].ints(258) == [8]


def test_bad_headers():
    def ifds(data):
        return tiff.read_ifds(tiff.Bytes(io.BytesIO(data), len(data)))

    for bad in (b"", b"II", struct.pack("<HHI", 0x1234, 42, 8) + bytes(20), struct.pack("<2sHI", b"II", 41, 8) + bytes(20), struct.pack("<2sHI", b"II", 42, 4) + bytes(20), struct.pack("<2sHI", b"II", 42, 999) + bytes(20), struct.pack("<2sHHHQ", b"II", 43, 4, 0, 16) + bytes(30)):
        with pytest.raises(errors.InvalidHeader):
            ifds(bad)
    loop = bytearray(make(image(), overview=image(9, 9)))
    first = struct.unpack("<I", loop[4:8])[0]
    loop[-4:] = struct.pack("<I", first)
    assert len(ifds(bytes(loop))) == 2
    minimal = struct.pack("<2sHIH", b"II", 42, 8, 2) + struct.pack("<HHII", 256, 4, 1, 800) + struct.pack("<HHII", 257, 4, 1, 600) + bytes(4)
    assert [(i.one(256), i.one(257)) for i in ifds(minimal)] == [(800, 600)]
    minimal = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, 2) + struct.pack("<HHQQ", 256, 4, 1, 1024) + struct.pack("<HHQQ", 257, 4, 1, 768) + bytes(8)
    assert [(i.one(256), i.one(257), i.big) for i in ifds(minimal)] == [(1024, 768, True)]


def test_relations_and_modes(engine, spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(make(image(), tile=16, keys=KEYS_3857, overview=image(25, 18)))
    (tmp_path / "b.tif").write_bytes(b"II*\0 broken")
    (tmp_path / "c.txt").write_bytes(b"no raster")
    rows = {(r["path"].rsplit("/", 1)[-1], r["ifd_no"]): r for r in engine.read(str(tmp_path)).collect()}
    assert rows["a.tif", 0]["epsg"] == 3857 and rows["a.tif", 1]["subfile"] == 1 and "outside" in rows["b.tif", None]["error"]
    assert engine.read(str(tmp_path), "tags").where("tag = 305").first()["text"] == "made by hand"
    assert {r["key_id"]: r["value"] for r in engine.read(str(tmp_path), "geokeys").where("ifd_no = 0").collect()} == {1024: "1", 3072: "3857"}
    blocks = engine.read(str(tmp_path), "blocks").where("ifd_no = 0 and bx >= 2 and by = 1")
    assert [(r["bx"], r["by"], r["w"], r["h"]) for r in blocks.orderBy("bx").collect()] == [(2, 1, 16, 16), (3, 1, 2, 16)]
    with pytest.raises(Exception, match="outside"):
        RasterEngine(spark, "failfast").read(str(tmp_path)).collect()
    with pytest.raises(errors.Unsupported):
        engine.image(str(tmp_path / "c.txt"))


def test_long_chains_and_broken_ones(engine, spark, tmp_path):
    out = io.BytesIO()
    writer = writers.TiffWriter(out)
    for k in range(103):
        writer.directory({254: (4, [int(k > 0)]), 256: (4, [k + 1]), 257: (4, [1])})
    (tmp_path / "long.tif").write_bytes(out.getvalue())
    assert engine.read(str(tmp_path)).count() == 103
    some = spark.read.format("raster").option("most_ifds", 5).load(str(tmp_path)).orderBy("ifd_no").collect()
    assert len(some) == 5 and "first 5" in some[-1]["error"] and some[0]["error"] is None
    data = bytearray(make(image(), overview=image(9, 9)))
    second = tiff.read_ifds(tiff.Bytes(io.BytesIO(bytes(data)), len(data)))[1].offset
    data[second : second + 2] = b"\xff\xff"
    (tmp_path / "long.tif").write_bytes(data)
    (row,) = engine.read(str(tmp_path)).collect()
    assert row["width"] == 50 and "directory 1" in row["error"]
    assert (grid(engine.pixels(str(tmp_path / "long.tif")), 50, 37) == image()).all()
    with pytest.raises(Exception, match="directory 1"):
        RasterEngine(spark, "failfast").read(str(tmp_path)).collect()


def test_large_files_are_dealt(engine, tmp_path, monkeypatch):
    monkeypatch.setattr(tiff, "LARGE", 500)
    v = image(90, 80)
    for tile in (None, 16):
        (tmp_path / "l.tif").write_bytes(make(v, rows=7, tile=tile))
        reader = tiff.RasterReader("blocks", str(tmp_path), False)
        parts = reader.partitions()
        assert len(parts) > 10
        found = sorted(r[2] for p in parts for r in reader._rows(p))
        assert found == list(range(30 if tile else 12))


def test_palette_file(engine, tmp_path):
    v = image(30, 20)
    (tmp_path / "g.tif").write_bytes(make(v))
    (tmp_path / "c.csv").write_text("0,0,0,255\n100,0,255,0\n255,255,0,0\n")
    engine.save_palette(str(tmp_path / "g.tif"), str(tmp_path / "p.tif"), str(tmp_path / "c.csv"), 8)
    assert (grid(engine.pixels(str(tmp_path / "p.tif")), 30, 20) == v).all()
    entries, _ = colormaps.read_colormap(engine.spark, str(tmp_path / "p.tif"))
    got = {r["value"]: (r["r"], r["g"], r["b"]) for r in entries.collect()}
    assert got[0] == (0, 0, 255) and got[100] == (0, 255, 0) and got[255] == (255, 0, 0) and got[50][1:] == (127, 127)


def test_damaged_block_is_zero_or_an_error(engine, spark, tmp_path):
    v = image(20, 20)
    data = bytearray(make(v, rows=10, compression=8))
    at = tiff.read_ifds(tiff.Bytes(io.BytesIO(bytes(data)), len(data)))[0].ints(273)[1]
    data[at : at + 10] = bytes(10)
    path = str(tmp_path / "d.tif")
    (tmp_path / "d.tif").write_bytes(data)
    got = grid(engine.pixels(path), 20, 20)
    assert (got[:10] == v[:10]).all() and (got[10:] == 0).all()
    with pytest.raises(Exception, match="decompressing"):
        RasterEngine(spark, "failfast").pixels(path).collect()


def test_unsupported_layouts(engine, tmp_path):
    for more in ({258: (3, [16])}, {277: (3, [3])}, {317: (3, [3])}, {259: (3, [5])}):
        (tmp_path / "u.tif").write_bytes(make(image(8, 8), more=more))
        with pytest.raises(errors.Unsupported):
            engine.pixels(str(tmp_path / "u.tif"))


def read_back(data):
    """Width, height, samples and bytes of a written TIFF."""
    ifd = tiff.read_ifds(tiff.Bytes(io.BytesIO(data), len(data)))[0]
    codec = codecs.codec(ifd.one(259, 1))
    raw = b"".join(codec.decode(data[o : o + n]) for o, n in zip(ifd.ints(273), ifd.ints(279), strict=True))
    return ifd, np.frombuffer(raw, np.uint8).reshape(ifd.one(257), ifd.one(256), -1)


def read_png(data):
    at, raw = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack(">IIBB", body[:10])
        raw += body if kind == b"IDAT" else b""
        at += 12 + n
    samples = {0: 1, 2: 3, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + w * samples)
    return lines[:, 1:].reshape(h, w, samples)


def test_extract_crop_and_georeference(engine, tmp_path):
    v = image(60, 50)
    path = str(tmp_path / "g.tif")
    (tmp_path / "g.tif").write_bytes(make(v, ">", predictor=2, compression=8, keys=KEYS_3857, tie=(2.0, 1.0, 0.0, 1020.0, 4990.0, 0.0), more={42113: (2, b" 9 \0")}))
    ifd, got = read_back(engine.extract_to_buffer(path, region=(20, 21, 30, 10), compression=14, proj="EPSG:32633"))
    assert (got[..., 0] == v[21:31, 20:50]).all()
    assert ifd.doubles(33922) == [0, 0, 0, 1000 + 200, 5000 - 210, 0] and ifd.doubles(33550) == [10, 10, 0]
    assert ifd.text(42113) == "9" and "NODATA_VALUES\">9<" in ifd.text(42112) and ifd.get(317) is None and ifd.text(305) == "made by hand"
    assert ifd.geokey(3072) == 32633
    ifd, got = read_back(engine.extract_to_buffer(path))
    assert (got[..., 0] == v).all() and ifd.geokey(3072) == 3857
    with pytest.raises(errors.BadRequest):
        engine.extract_to_buffer(path, region=(50, 0, 20, 10))
    with pytest.raises(errors.BadRequest):
        engine.extract_to_buffer(path, radius=5)


def test_extract_filter_colormap_circle(engine, tmp_path):
    v = image(40, 30)
    path = str(tmp_path / "f.tif")
    (tmp_path / "f.tif").write_bytes(make(v))
    (tmp_path / "m.csv").write_text("# colours\n0,#0a00fa,low\n100, 200, 51, 50\n200,#00ff00\nbad\n")
    engine.extract(path, str(tmp_path / "o.png"), filter="40,120")
    assert (read_png((tmp_path / "o.png").read_bytes())[..., 0] == np.where((v >= 40) & (v <= 120), v, 0)).all()
    engine.extract(path, str(tmp_path / "o2.png"), filter="40,120", filter_transparent=True)
    assert (read_png((tmp_path / "o2.png").read_bytes())[..., 3] == np.where((v >= 40) & (v <= 120), 255, 0)).all()
    engine.extract(path, str(tmp_path / "c.jpg"), shape="circle")
    circle = read_png((tmp_path / "c.png").read_bytes())
    y, x = np.mgrid[:30, :40]
    assert (circle[..., 3] == np.where((x - 20) ** 2 + (y - 15) ** 2 <= 15**2, 255, 0)).all()
    engine.extract_with_colormap(path, str(tmp_path / "k.tif"), str(tmp_path / "m.csv"))
    _, got = read_back((tmp_path / "k.tif").read_bytes())
    for value, colour in {0: (10, 0, 250), 33: (72, 16, 183), 50: (105, 25, 150), 150: (100, 153, 25), 151: (98, 155, 24), 230: (0, 255, 0), 255: (255, 255, 255)}.items():
        assert (got[v == value] == colour).all()


def test_lookup_tables(spark):
    entries = spark.createDataFrame([(0, None, 10, 0, 250), (100, None, 200, 51, 50), (200, None, 0, 255, 0)], "value int, label string, r int, g int, b int")
    near = {r["v"]: (r["r"], r["g"], r["b"]) for r in palette.lookup_table(entries, "intervals").collect()}
    assert near[50] == (10, 0, 250) and near[150] == (200, 51, 50) and near[151] == (0, 255, 0)
    none = palette.lookup_table(entries.limit(0)).collect()
    assert len(none) == 256 and {(r["r"], r["g"], r["b"]) for r in none if r["v"] < 255} == {(0, 0, 0)}
    sizes = {m: palette.palette_size(spark.createDataFrame([(m,)], "value int")).first()["size"] for m in (0, 1, 2, 3, 4, 200, 255, 256)}
    assert sizes == {0: 2, 1: 2, 2: 4, 3: 4, 4: 8, 200: 256, 255: 256, 256: 512}
    gap = palette.palette_table(spark.createDataFrame([(0, 10, 0, 0), (4, 50, 0, 0)], "value int, r int, g int, b int"), 8)
    assert [r["r"] for r in gap.orderBy("v").collect()][1:4] == [5140, 7710, 10280]


def test_palette_files_and_styles(engine, spark, tmp_path):
    table = [(0, 0, 0), (0, 0, 0), (257, 514, 65535)] + [(i * 257, 0, 0) for i in range(3, 256)]
    flat = writers.palette_tag(table)[1]
    (tmp_path / "p.tif").write_bytes(make(image(8, 8), more={262: (3, [3]), 320: (3, flat)}))
    entries = engine.extract_colormap(str(tmp_path / "p.tif"), str(tmp_path / "s.sld"), "a <name>")
    assert entries.count() == 254 and entries.orderBy("value").first()["b"] == 255
    back, kind = colormaps.read_colormap(spark, str(tmp_path / "s.sld"))
    assert kind == "ramp" and sorted(map(tuple, back.select("value", "r", "g", "b").collect())) == sorted(map(tuple, entries.select("value", "r", "g", "b").collect()))
    assert "<sld:Name>a &lt;name&gt;</sld:Name>" in (tmp_path / "s.sld").read_text()
    (tmp_path / "s2").write_text((tmp_path / "s.sld").read_text())
    assert colormaps.kind_of(spark, str(tmp_path / "s2")) == "sld"
    (tmp_path / "empty.csv").write_text("# nothing\n")
    with pytest.raises(errors.BadRequest):
        colormaps.read_colormap(spark, str(tmp_path / "empty.csv"))


def test_arrays(engine, tmp_path):
    v = image(100, 20)
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(make(v))
    for kind in ("csv", "JSON", "npy"):
        engine.extract_to_array(path, str(tmp_path / kind), kind, region=(5, 2, 90, 10))
    want = v[2:12, 5:95]
    lines = (tmp_path / "csv").read_text().splitlines()
    assert lines[0] == "row/col," + ",".join(map(str, range(90))) and lines[3] == "2," + ",".join(map(str, want[2]))
    got = json.loads((tmp_path / "JSON").read_text())
    assert got["width"] == 90 and got["height"] == 10 and (np.array(got["data"]) == want).all()
    assert (np.load(tmp_path / "npy") == want).all()
    with pytest.raises(errors.BadRequest):
        engine.extract_to_array(path, str(tmp_path / "x"), "xml")
    out = io.BytesIO()
    writers.write_npy(out, [bytes(100)] * 100, 100, 100)
    assert out.getvalue()[8:10] == struct.pack("<H", 118)


@pytest.mark.parametrize("order,big,tile", [("<", False, None), (">", True, 16)])
def test_convert_compression(engine, tmp_path, order, big, tile):
    v, small = image(), image(25, 18)
    (tmp_path / "i.tif").write_bytes(make(v, order, big, tile, 37, 8, 2, keys=KEYS_4326, overview=small))
    path = str(tmp_path / "o.tif")
    engine.convert_compression(str(tmp_path / "i.tif"), path, "zstd")
    ifds = tiff.load(path)
    assert [i.one(259) for i in ifds] == [14, 14] and ifds[0].big == big and ifds[0].geokey(2048) == 4326 and ifds[1].one(254) == 1
    assert (grid(engine.pixels(path), 50, 37) == v).all() and (grid(engine.pixels(path, ifd_no=1), 25, 18) == small).all()
    with pytest.raises(errors.Unsupported):
        engine.convert_compression(str(tmp_path / "i.tif"), path, "lzw")


def test_regions(engine, spark):
    def found(box, source, target, g, size):
        cols = geo.region(tuple(F.lit(float(v)) for v in box), F.lit(source).cast("int"), F.lit(target).cast("int"), *(F.lit(float(x)) for x in g), *(F.lit(n).cast("long") for n in size))
        return tuple(spark.range(1).select(*cols).first())

    g, size = (1000, 10, 5000, -10), (100, 80)
    assert found((1015, 4515, 1095, 4785), 3857, 3857, g, size) == (1, 21, 9, 27)
    assert found((950, 4900, 1095, 5100), 3857, 3857, g, size) == (0, 0, 15, 20)
    assert found((1015, 4785, 1095, 4515), 3857, 3857, g, size) == (1, 48, 9, 1)
    assert found((3000, 4500, 3100, 4600), 3857, 3857, g, size) == (99, 40, 1, 10)
    assert found((3, 4, 13, 9), None, 3857, g, size) == (3, 4, 10, 5)
    around = tuple(spark.range(1).select(*geo.radius_box(F.lit(-109.22624), F.lit(56.13484), F.lit(5000.0), F.lit(4326))).first())
    assert np.allclose(around, (-109.306843572, 56.089924441, -109.145636428, 56.179755559))
    assert found(around, 4326, 3857, (-12200000, 30, 7620000, -30), (4000, 4000)) == (1067, 857, 599, 598)
    assert found((0, 0, 1, 1), 4326, 3857, (-12200000, 30, 7620000, -30), (4000, 4000)) == (1500, 1500, 1000, 1000)


def test_resolve_choices(engine, tmp_path):
    (tmp_path / "r.tif").write_bytes(make(image(100, 80), keys=KEYS_3857))
    image_ = engine.image(str(tmp_path / "r.tif"))
    assert engine.resolve(image_, bbox="1015,4785,1095,4515", crs="epsg:3857") == (1, 21, 9, 27)
    assert engine.resolve(image_, bbox="1015,4785,1095,4515", crs=3857, strict=True) == (1, 48, 9, 1)
    assert engine.resolve(image_, bbox="1015,4785,1095,4515", crs=3857, coordinate="1500,4500", radius=50) == (45, 45, 10, 10)
    assert engine.resolve(image_, bbox="1,2,11,12") == (1, 2, 10, 10)
    with pytest.raises(errors.BadRequest):
        engine.resolve(image_, bbox="50,50,51,51", crs=4326, on_outside="raise")
    (tmp_path / "w.tif").write_bytes(make(image(100, 80), keys=KEYS_4326, scale=(1.0, 1.0, 0.0), tie=(0.0, 0.0, 0.0, 0.0, 80.0, 0.0)))
    assert engine.resolve(engine.image(str(tmp_path / "w.tif")), bbox="10,20,30,40", crs=4326) == (10, 40, 20, 20)


def test_points_and_names(spark):
    one = spark.range(1)
    x, y = geo.mercator(F.lit(-109.22624), F.lit(56.13484))
    assert np.allclose(tuple(one.select(x, y).first()), (-12159009.418064, 7585305.448494))
    x, y = geo.box_mercator(F.lit(-109.22624), F.lit(56.13484))
    assert np.allclose(tuple(one.select(x, y).first()), (-12159009.416371, 7585305.447438))
    with pytest.raises(Exception, match="no way"):
        one.select(*geo.transform(F.lit(1.0), F.lit(1.0), F.lit(4326), F.lit(2154))).collect()
    with pytest.raises(Exception, match="EPSG"):
        one.select(geo.parse_crs(F.lit("wgs84"))).collect()
    assert one.select(names.describe_projected(F.lit(32633))).first()[0] == "WGS 84 / UTM Northern Hemisphere zone 33"
    assert one.select(colours.hex_decode(F.lit("##0Aff10"))).first()[0].asDict() == {"r": 10, "g": 255, "b": 16}
    assert pixels.parse_range(" 3, 200") == (3, 200)
    for bad in ("1", "5,4", "0,256", "a,b", "-1,3"):
        with pytest.raises(errors.BadRequest):
            pixels.parse_range(bad)
    assert with_epsg([1, 1, 0, 1, 1024, 0, 1, 1], 3857) == [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 3857]


def test_code_table(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[projected_cs_codes]\n2000 = "Some_CS"\nword = "dropped"\n')
    codes = names.code_table(spark, str(tmp_path / "c.toml"))
    assert [r["name"] for r in codes.where("code_type = 'projected_cs'").collect()] == ["Some_CS"]
    assert [r["n"] for r in names.name_codes(spark.createDataFrame([(2000,), (7,)], "c int"), codes, "projected_cs", "c", "n").orderBy("c").collect()] == ["7", "Some_CS"]


def test_codecs():
    for c in codecs.CODECS.values():
        assert c.decode(c.encode(b"abc" * 100)) == b"abc" * 100 and c.decode(c.encode(b"")) == b""
    assert codecs.convert(zlib.compress(b"x"), 32946, 1) == b"x" and codecs.codec_named(" Adobe Deflate ").code == 8
    assert codecs.undo_predictor(np.array([[250, 10, 3, 255]], np.uint8)).tolist() == [[250, 4, 7, 6]]


def test_report_and_cli(engine, tmp_path):
    from gridwright import cli

    (tmp_path / "r.tif").write_bytes(make(image(), keys=KEYS_3857))
    args = lambda *a: cli.parser().parse_args([str(tmp_path / "r.tif"), *a])
    text = cli.run(engine, args())
    assert "50 x 37" in text and "Web Mercator (EPSG:3857)" in text and "ImageWidth" in text
    cli.run(engine, args("-e", "-o", str(tmp_path / "x.tif"), "--region", "1,2,10,5"))
    assert tiff.load(str(tmp_path / "x.tif"))[0].one(256) == 10
    cli.run(engine, args("--extract-array", "-o", str(tmp_path / "x.csv")))
    cli.run(engine, args("-c", "-o", str(tmp_path / "z.tif"), "--compression", "14"))
    assert tiff.load(str(tmp_path / "z.tif"))[0].one(259) == 14
    assert engine.list_compression_methods() == [(1, "Uncompressed"), (8, "Adobe Deflate"), (14, "ZSTD")]


def test_stream_of_files(spark, tmp_path):
    from gridwright.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(make(image(10, 6)))
    (tmp_path / "in" / "b.tif").write_bytes(b"broken file")
    for f, name in ((watch.ifds, "headers"), (watch.pixels, "cells")):
        q = f(watch.files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert spark.table("headers").where("error is null").first()["width"] == 10 and spark.table("headers").count() == 2
    assert spark.table("cells").where("error is null").count() == 60
    (broken,) = spark.table("cells").where("error is not null").collect()
    assert broken["path"].endswith("b.tif") and broken["v"] is None
