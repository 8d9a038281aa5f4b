"""Plans of the portfolio engine."""
