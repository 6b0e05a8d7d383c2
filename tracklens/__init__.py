"""Search and enrichment of recording catalogues on Spark DataFrames."""
