"""leafmark: text-quality analytics for page-level documents, on Spark DataFrames."""
