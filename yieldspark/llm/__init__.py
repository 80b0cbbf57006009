"""Operators for preparing training data: tokens, duplicates, quality, personal data, archives."""
