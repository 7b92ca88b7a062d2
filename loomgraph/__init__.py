"""loomgraph: code-graph, retrieval, review and corpus analytics on Spark DataFrames."""
