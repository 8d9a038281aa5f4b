"""Sources of the portfolio engine."""
