"""Occupancy history of places from periodic snapshots, on PySpark DataFrames."""
