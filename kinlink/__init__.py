"""Record linkage and data-quality operators on Spark DataFrames."""
