"""sluice: a pipe-first analytics engine on Spark DataFrames."""
