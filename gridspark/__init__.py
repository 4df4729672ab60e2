"""gridspark: raster, vector and terrain-flow analytics as Spark plans."""
