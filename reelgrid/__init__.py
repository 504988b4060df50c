"""reelgrid: a PySpark-native engine for film and series catalogues."""

__version__ = "0.1.0"
