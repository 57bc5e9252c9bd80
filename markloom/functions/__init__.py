"""Column expressions: decoding, sanitising, pattern matching, tokenising."""
