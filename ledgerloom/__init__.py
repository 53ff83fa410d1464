"""A Spark-native engine that turns account statements into a classified ledger."""
