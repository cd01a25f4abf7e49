"""cairn: spatial tile, point-cloud and catalogue analytics as PySpark DataFrames."""
