"""Search operators: top-k, range, recent window; one meaning, whatever finds the rows."""
