"""tidebar: market bar, signal and trade-ledger analytics as Spark DataFrame jobs."""
