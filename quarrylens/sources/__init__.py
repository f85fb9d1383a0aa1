"""Loading tables, naming them, and writing results."""
