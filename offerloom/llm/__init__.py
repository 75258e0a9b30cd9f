"""Operators that prepare text for language-model training; nothing else in the library imports this folder."""
