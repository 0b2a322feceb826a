"""Spark ML classifiers, calibration, search and the benchmark run."""
