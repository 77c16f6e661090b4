"""A PySpark-native engine for vector-centric evolutionary analytics."""
