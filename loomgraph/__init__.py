"""loomgraph: a Spark-native context-graph analytics engine."""

__version__ = "0.1.0"
