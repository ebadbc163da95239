"""Operators for building text training corpora (one module each; queries.py registers them)."""
