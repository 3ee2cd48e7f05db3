"""A PySpark-native analytics engine: chains of DataFrame stages, histograms, profiling, association, repair and mimicry."""

__version__ = "0.1.0"
