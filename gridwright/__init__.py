"""Raster analytics on Spark: TIFF and GeoTIFF files as DataFrames of directories, tags, blocks and pixels.

The façade is gridwright.plans.engine.RasterEngine; importing the package alone loads nothing.
"""
