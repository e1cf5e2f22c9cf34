"""Reconcile overlapping source snapshots into entity state with Spark DataFrames."""
