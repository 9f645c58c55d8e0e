"""civicflow: Spark-native analytics for citizen messages, addresses and events."""
