"""Schemas of the relations that a raster is made of, as DDL."""

FILES = "path string, length long, content binary"
IFDS = (
    "path string, ifd_no int, ifd_offset long, big_tiff boolean, little_endian boolean, entry_count int, width long, height long, bits array<int>, samples int, "
    "compression int, photometric int, predictor int, planar int, sample_format int, tile_w int, tile_h int, rows_per_strip long, subfile int, "
    "scale array<double>, tiepoint array<double>, epsg int, geographic int, projection int, nodata string, metadata string, error string"
)
TAGS = "path string, ifd_no int, seq int, tag int, field_type int, count long, value_offset long, ints array<long>, doubles array<double>, text string"
GEOKEYS = "path string, ifd_no int, key_id int, location int, count int, value_offset int, value string"
BLOCKS = "path string, ifd_no int, block_no int, bx int, by int, x0 int, y0 int, w int, h int, stride int, compression int, predictor int, offset long, byte_count long, data binary, error string"
PIXELS = "path string, x int, y int, v int"
COLORMAP = "value int, label string, r int, g int, b int"
CODES = "code_type string, code int, name string"
