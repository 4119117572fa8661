"""Column helpers and fixed format values."""
