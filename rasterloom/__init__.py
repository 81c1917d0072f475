"""Multiresolution raster analytics on PySpark: specifications, channel programs, and whole-image coding.

``encode_rasters`` and ``decode_rasters`` take rows to containers and back.
"""

from .errors import HeaderError, MalformedError, RasterError, UnderflowError
from .operators.codec import decode_rasters, decoded_cells, encode_rasters
from .spec import Program, Spec

__all__ = [
    "HeaderError", "MalformedError", "Program", "RasterError", "Spec", "UnderflowError", "decode_rasters", "decoded_cells", "encode_rasters",
]
