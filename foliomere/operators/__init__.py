"""Operators of the portfolio engine."""
