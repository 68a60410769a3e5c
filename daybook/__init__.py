"""daybook: a PySpark-native analytics engine for day-keyed document archives."""
