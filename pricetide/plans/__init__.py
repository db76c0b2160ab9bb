"""Whole jobs: landed files to feature tables, models and reports."""
