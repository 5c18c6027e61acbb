"""Spark-native gridded hazard analytics: operators, sources, functions, plans and streams over DataFrames."""
