"""Document scanning and analytics over Spark DataFrames."""
