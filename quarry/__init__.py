"""quarry: catalog preparation, vector search and corpus tooling as lazy Spark plans."""

__version__ = "0.1.0"
