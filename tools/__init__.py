"""Development tools."""
