"""burstgraph: learning and testing activity graphs with Spark DataFrames."""

from burstgraph.operators.graph import PropertyGraph

__all__ = ["PropertyGraph"]
