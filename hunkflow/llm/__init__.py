"""Operators for preparing training data, each usable on its own."""
