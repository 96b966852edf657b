"""Operators for preparing training text, and their queries over the driver's tables."""
