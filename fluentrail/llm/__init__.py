"""Operators for preparing training data: tokens, windows, duplicates, search, checks and labels."""
