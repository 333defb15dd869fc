"""Streaming of lithoframe."""
