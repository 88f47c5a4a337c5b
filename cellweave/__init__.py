"""Raster analytics, remote sensing and land modelling on Spark DataFrames."""
