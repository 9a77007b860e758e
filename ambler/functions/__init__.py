"""Column functions: counter-based randomness, choices, arrays, arithmetic."""
