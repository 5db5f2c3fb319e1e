"""mosaiq: embedding-based identity and similarity analytics on PySpark."""

__version__ = "0.1.0"
