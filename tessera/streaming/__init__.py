"""Change feeds and batched delivery."""
