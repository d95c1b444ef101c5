"""A code-graph analytics engine on Spark: source files to symbols, edges, chunks and diagnostics, and queries over them."""

from importlib import metadata

try:
    __version__ = metadata.version("codeloom")
except metadata.PackageNotFoundError:  # run from a checkout
    __version__ = "0.1.0"
