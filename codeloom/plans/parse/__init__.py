"""Parsers: a file's text to symbols, edges and error spans, and the Spark operator that runs them."""
