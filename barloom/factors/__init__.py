"""The factor library: every factor is an expression, found by name and arguments."""
