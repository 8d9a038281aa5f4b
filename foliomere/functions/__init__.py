"""Functions of the portfolio engine."""
