"""Sources of lithoframe."""
