"""Command line: python -m gridwright.cli INPUT [options]. Extraction comes before conversion, and that before analysis."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from gridwright.errors import BadRequest
from gridwright.plans.engine import RasterEngine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridwright")
    p.add_argument("input")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-e", "--extract", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("--region", help="x,y,width,height in pixels")
    p.add_argument("--bbox", help="min_x,min_y,max_x,max_y")
    p.add_argument("--crs", "--epsg", dest="crs", help="system of the box or coordinate; without it they are pixels")
    p.add_argument("--proj", help="EPSG code to write")
    p.add_argument("--coordinate", help="x,y")
    p.add_argument("--radius", type=float)
    p.add_argument("--shape", choices=("square", "circle"), default="square")
    p.add_argument("--extract-array", action="store_true")
    p.add_argument("--array-format", default="csv")
    p.add_argument("--filter", help="min,max")
    p.add_argument("--filter-transparency", action="store_true")
    p.add_argument("--colormap-output")
    p.add_argument("--colormap-input")
    p.add_argument("-c", "--convert", action="store_true")
    p.add_argument("--compression", type=int)
    p.add_argument("--compression-name")
    return p


def run(engine: RasterEngine, args: argparse.Namespace) -> str | None:
    where = {"region": tuple(map(int, args.region.split(","))) if args.region else None, "bbox": args.bbox, "crs": args.crs, "coordinate": args.coordinate, "radius": args.radius}
    if (args.extract or args.extract_array or args.convert) and not args.output:
        raise BadRequest("an output is needed")
    if args.colormap_output:
        engine.extract_colormap(args.input, args.colormap_output)
    if args.extract_array:
        engine.extract_to_array(args.input, args.output, args.array_format, **where)
    elif args.extract:
        engine.extract(args.input, args.output, **where, shape=args.shape, filter=args.filter, filter_transparent=args.filter_transparency, colormap=args.colormap_input, proj=args.proj)
    elif args.convert:
        wanted = args.compression if args.compression is not None else args.compression_name
        if wanted is None:
            raise BadRequest("a compression is needed")
        engine.convert_compression(args.input, args.output, wanted)
    elif not args.colormap_output:
        return engine.report(args.input)
    return None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(levelname)s %(name)s %(message)s")
    text = run(RasterEngine(SparkSession.builder.appName("gridwright").getOrCreate()), args)
    if text:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
