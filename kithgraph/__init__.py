"""kithgraph: relationship-graph analytics on Spark DataFrames."""
