"""Skylattice: a PySpark-native engine for transient-event search analytics."""

__version__ = "0.1.0"
