"""spendlake streaming."""
