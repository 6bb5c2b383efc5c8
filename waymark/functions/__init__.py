"""Column-to-column expressions; no Python runs in any of them."""
