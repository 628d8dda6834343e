"""Column expressions: no shuffles, no Python workers unless the name says so."""
