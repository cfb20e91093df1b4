"""leafloom: document analytics expressed as Spark DataFrames."""
