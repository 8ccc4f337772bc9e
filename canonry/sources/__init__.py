"""Readers: table scans, CSV and XLSX grids."""
