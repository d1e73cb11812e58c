"""Edge sources and the run log."""
