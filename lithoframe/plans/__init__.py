"""Plans of lithoframe."""
