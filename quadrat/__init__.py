"""Design-based analysis of complex survey samples on Spark DataFrames."""
