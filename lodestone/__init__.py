"""Lodestone: product-evidence analytics and text processing on Spark DataFrames."""
