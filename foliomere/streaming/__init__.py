"""Streaming of the portfolio engine."""
