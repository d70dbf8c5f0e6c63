"""Documents whose components arrive over time."""
