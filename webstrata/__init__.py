"""Spark-native analytics over captured web sites: extraction, link graph, dashboards, findings and ratings."""
