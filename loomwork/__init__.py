"""Latent-programme analytics on sparse count matrices, as Spark DataFrames."""
