"""Relational operators over values, mappings, queues and exports."""
