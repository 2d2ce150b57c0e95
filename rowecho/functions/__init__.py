"""Column expressions: value and row text, template filling, draws, answer checks."""
