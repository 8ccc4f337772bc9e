"""Scalar functions: normalization, conventions, naming scores and schedules."""
