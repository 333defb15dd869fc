"""Operators of lithoframe."""
