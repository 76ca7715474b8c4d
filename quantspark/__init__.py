"""quantspark: a PySpark-native engine for daily market-data research."""
