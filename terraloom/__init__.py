"""terraloom: image-to-ground geometry and terrain analytics on PySpark."""

__version__ = "0.1.0"
