"""spendlake sinks."""
