"""Raster analytics on Spark: an image is a relation of pixels, an operator is a DataFrame function."""
