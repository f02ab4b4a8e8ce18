"""Column expressions, and their plain counterparts for driver-side values."""
