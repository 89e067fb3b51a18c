"""Spark-native knowledge-graph analytics: graph queries, rules, snapshots and incremental refresh as DataFrames."""
