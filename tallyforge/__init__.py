"""Tallyforge: set-based reconciliation of billing documents on Spark."""
