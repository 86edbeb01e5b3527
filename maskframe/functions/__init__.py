"""Column functions: scalars, bits, fixed point and containers."""
