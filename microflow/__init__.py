"""microflow: Spark-native analytics of exchange event streams."""
