"""Errors at the edge of the API; batch operators report a ``status`` column instead."""


class RasterError(ValueError):
    """A raster, a header or a container that can't be processed."""


class HeaderError(RasterError):
    """A header field is out of range, or the bytes are no header."""


class UnderflowError(RasterError):
    """The container ends, or a block's bits end, before what they declare."""


class MalformedError(RasterError):
    """A channel program refers to a missing channel or divides by zero."""
