"""Operators for large-scale training text; optional, nothing else imports it."""
