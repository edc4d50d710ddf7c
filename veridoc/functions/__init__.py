"""Type declarations, value domains and checks."""
