"""tessera: a PySpark-native analytics engine for news, market and event data."""
