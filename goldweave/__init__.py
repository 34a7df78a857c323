"""goldweave: entity resolution and master data on Spark DataFrames."""
