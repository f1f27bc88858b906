"""tessel: typed property graphs, sparse algebra and graph sampling as PySpark DataFrame plans."""

__version__ = "0.1.0"
