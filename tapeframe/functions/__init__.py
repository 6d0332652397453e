"""Column expressions: cleaning, finance arithmetic and scoring rules."""
