"""Column expressions: text, addresses, prices."""
