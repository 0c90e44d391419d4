"""Column-level building blocks: hashing, score formulas, small statistics."""
