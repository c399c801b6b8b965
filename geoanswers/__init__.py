"""Measured analytics over tables of features, legs, cells and run logs, as Spark jobs."""
