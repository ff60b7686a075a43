"""Streaming over the operation log."""
