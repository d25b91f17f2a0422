"""Whole runs, reports and the catalogue of queries."""
