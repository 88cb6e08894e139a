"""Readers of catalog rows, collections and URLs."""
