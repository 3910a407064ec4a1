"""Column expressions: text, clocks, channels, labels."""
