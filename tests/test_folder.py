import numpy as np
import pytest

from gridwright.plans import folder
from gridwright.plans.engine import RasterEngine
from gridwright.sources import tiff
from tests.test_raster import KEYS_3857, grid, image, make


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    home = tmp_path_factory.mktemp("files")
    images = {}
    for i in range(4):
        images[f"f{i}.tif"] = image(60, 50, i)
        (home / f"f{i}.tif").write_bytes(make(images[f"f{i}.tif"], "<>"[i % 2], tile=16 if i > 1 else None, compression=8, predictor=2, keys=KEYS_3857, tie=(0.0, 0.0, 0.0, 1000.0 + 100 * i, 5000.0, 0.0)))
    (home / "bad.tif").write_bytes(b"not a raster")
    (home / "wide.tif").write_bytes(make(image(8, 8), more={258: (3, [16])}))
    return str(home), images


def test_crop_and_stats(spark, files):
    home, images = files
    engine = RasterEngine(spark)
    got, failed = {}, set()
    for r in folder.crop(engine, home, (1300.0, 4700.0, 1400.0, 4900.0), 3857).collect():
        if r["error"]:
            assert r["path"].endswith(("bad.tif", "wide.tif")) and r["x"] is r["y"] is r["v"] is None
            failed.add(r["path"].rsplit("/", 1)[-1])
            continue
        got.setdefault(r["path"].rsplit("/", 1)[-1], {})[r["x"], r["y"]] = r["v"]
    for i in range(4):
        want = images[f"f{i}.tif"][10:30, 30 - 10 * i : 40 - 10 * i]
        assert got[f"f{i}.tif"] == {(x, y): want[y, x] for y in range(20) for x in range(10)}
    assert failed == {"bad.tif", "wide.tif"}
    stats = {r["path"].rsplit("/", 1)[-1]: r for r in folder.stats(engine, home).collect()}
    assert {k: (r["min_value"], r["max_value"]) for k, r in stats.items() if not r["error"]} == {k: (v.min(), v.max()) for k, v in images.items()}
    assert "16" in stats["wide.tif"]["error"] and "Header" in stats["bad.tif"]["error"]


def test_convert(spark, files, tmp_path):
    home, images = files
    engine = RasterEngine(spark)
    done = {r["path"].rsplit("/", 1)[-1]: r for r in folder.convert_compression(engine, home, str(tmp_path / "out"), "zstd").collect()}
    assert done["bad.tif"]["error"] and not done["f0.tif"]["error"]
    for name, v in images.items():
        path = str(tmp_path / "out" / name)
        assert tiff.load(path)[0].one(259) == 14
        assert (grid(engine.pixels(path), 60, 50) == v).all() and np.any(v)
