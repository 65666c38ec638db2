"""threadloom: analytics over discussion threads and labelled text, on Spark DataFrames."""
