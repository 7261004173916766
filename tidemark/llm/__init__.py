"""Operators on texts for language models. Nothing outside imports this package."""
