"""Extras beyond batch: scoring of streams with fitted tables."""
