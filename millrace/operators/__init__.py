"""DataFrame operators. They take column names, so the same function serves any table of the right shape."""
