"""gridloom: object analytics over tiled rasters and keyed point tables, on Spark DataFrames."""
