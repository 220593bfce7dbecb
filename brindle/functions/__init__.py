"""Column expressions and small Python kernels."""
