"""Reporting tables."""
