"""haulmark: Spark-native document hauling, ledger folding and reconciliation."""
