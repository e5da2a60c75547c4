"""A PySpark-native analytics engine for supply-chain and customer data."""
