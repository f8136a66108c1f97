"""spendlake: cloud cost analytics as Spark DataFrame operators."""
