"""Redundancy, lineage and scene operators on Spark DataFrames."""
