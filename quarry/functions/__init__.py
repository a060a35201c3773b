"""Functions with MySQL's semantics."""
