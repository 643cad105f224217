"""Analytics for geo-referenced aerial imagery on Spark DataFrames."""
