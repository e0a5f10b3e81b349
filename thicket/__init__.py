"""thicket: a PySpark-native engine for tree-shaped document collections."""
