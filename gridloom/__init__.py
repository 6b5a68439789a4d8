"""Raster-to-vector analytics and image-dataset preparation as Spark DataFrame operators."""
