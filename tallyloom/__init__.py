"""tallyloom: text, graph and event analytics on Spark DataFrames."""
