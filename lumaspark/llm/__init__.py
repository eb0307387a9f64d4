"""Operators for preparing training text, each by its own method; see the README's section on them."""
