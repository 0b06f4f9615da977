"""What can go wrong with a raster file or a request."""


class RasterError(Exception):
    """Any error of this library."""


class InvalidHeader(RasterError):
    """Neither II nor MM, a wrong version, or a first directory outside the file."""


class Unsupported(RasterError):
    """A compression, sample layout or field type that is not read."""


class MissingTag(RasterError):
    """A tag that the request needs is not there."""


class BadRequest(RasterError):
    """A region, range, coordinate or format that makes no sense."""
