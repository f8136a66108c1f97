"""spendlake plans."""
