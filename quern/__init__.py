"""A PySpark-native search and text-analytics engine."""
