"""Functions of lithoframe."""
