"""Column expressions and small reusable DataFrame patterns."""
