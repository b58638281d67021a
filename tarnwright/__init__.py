"""Spark-native land-screening analytics: rasters as pixel tables, flow as a graph, rules as columns."""
