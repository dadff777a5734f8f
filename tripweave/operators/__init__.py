"""Site, trip, graph, community and sparse-matrix operators."""
