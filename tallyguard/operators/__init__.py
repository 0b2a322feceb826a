"""DataFrame operators: ordering, splits, windows, fitted transforms, metrics."""
