"""Place search, entity resolution and enrichment as Spark DataFrames."""
