"""Column-level functions and Arrow kernels."""
