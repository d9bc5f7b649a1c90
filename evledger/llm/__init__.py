"""Operators for preparing training data: text in, decisions, tokens and statistics out."""
