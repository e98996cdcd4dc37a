"""kithgraph: collaboration-graph analytics as Spark DataFrame operators."""
