"""Commerce analytics as Spark jobs: every job maps DataFrames to a DataFrame."""
