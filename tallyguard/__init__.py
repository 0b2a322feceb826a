"""Leakage-free event features and imbalance-aware evaluation on Spark DataFrames."""
