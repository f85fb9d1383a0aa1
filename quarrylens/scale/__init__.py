"""Building blocks that keep every task's share of the data bounded."""
