"""Column expressions and decoders for the byte formats."""
