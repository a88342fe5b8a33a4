"""Column functions: scalars (scalar), texts (text) and hashes of formulas."""
