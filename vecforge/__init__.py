"""Vecforge: vector quantization, search and training-data operators on Spark DataFrames."""
