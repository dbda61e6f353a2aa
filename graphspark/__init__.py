"""graphspark: property graphs, vectors and valid time on Spark DataFrames."""
