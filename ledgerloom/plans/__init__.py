"""Plans over the driver's tables."""
