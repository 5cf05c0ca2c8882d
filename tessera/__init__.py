"""Tessera: relational, window, text and streaming operators declared on PySpark DataFrames."""
