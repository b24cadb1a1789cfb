"""Relational operators over signatures, votes, candidates and predictions."""
