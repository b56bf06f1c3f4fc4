"""Column expressions and per-row text helpers shared by the operators."""
