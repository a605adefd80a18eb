"""Training analytics on Spark: activities, sections, routes, wellness, strength and insights as DataFrames."""
