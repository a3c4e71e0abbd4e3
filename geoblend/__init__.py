"""Spark jobs that fuse geo-located measurement sources into a cell-by-day table and a field with uncertainty."""
