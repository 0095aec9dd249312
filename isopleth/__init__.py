"""isopleth: a Spark-native analytics engine for gridded and panel time series."""

__version__ = "0.1.0"
