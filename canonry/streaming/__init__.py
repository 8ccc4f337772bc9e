"""Structured Streaming queue feed."""
