"""Relational, graph and text operators over the index."""
