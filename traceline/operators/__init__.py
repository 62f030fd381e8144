"""Decode, search, combine, evaluate: DataFrame in, DataFrame out."""
