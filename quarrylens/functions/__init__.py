"""Column-level helpers: kinds, value cleaning, wording bands and formulas."""
