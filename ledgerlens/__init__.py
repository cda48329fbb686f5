"""ledgerlens: banking-transaction analytics on Spark DataFrames and streams."""
