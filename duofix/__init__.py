"""Leave-out variance decompositions of two-way panels, on Spark DataFrames."""
