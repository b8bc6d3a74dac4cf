"""Operators for preparing training text; nothing else in readlake imports this package."""
