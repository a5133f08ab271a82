"""Operators for preparing text, page and embedding tables at corpus scale."""
