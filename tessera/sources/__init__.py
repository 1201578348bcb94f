"""Readers that turn files into index tables, and sinks that keep them current."""
