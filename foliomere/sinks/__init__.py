"""Sinks of the portfolio engine."""
