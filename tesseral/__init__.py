"""tesseral: dimensional analytics over documents, mentions and events, as PySpark plans."""

__version__ = "0.1.0"
