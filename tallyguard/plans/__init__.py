"""Queries over the shared test tables, with their SQL twins, and the end-to-end job."""
