"""Column expressions: dominance and geometry."""
