"""Column expressions and numpy kernels that operators share."""
