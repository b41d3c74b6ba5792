"""Knowledge-graph retrieval on Spark DataFrames."""
