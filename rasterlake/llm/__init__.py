"""Operators that prepare text for language-model training. Nothing outside imports this package."""
