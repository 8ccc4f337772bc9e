"""Registered queries and pipeline orchestration."""
