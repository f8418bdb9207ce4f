"""graphlens: property-graph analytics on Spark DataFrames."""
