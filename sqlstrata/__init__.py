"""SQL-corpus and lineage analytics as Spark DataFrames."""
