"""Barloom: Spark jobs for market-bar signal research and training-data preparation."""
