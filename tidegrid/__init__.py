"""tidegrid: many-series time-series analytics as PySpark DataFrame functions."""

__version__ = "0.1.0"
