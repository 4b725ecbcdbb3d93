"""Column expressions and Arrow functions over token sequences."""
