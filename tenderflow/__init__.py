"""Cash and tender reconciliation statements on Spark DataFrames."""
