"""Column expressions and small fixed lookups shared by the operators."""
