"""Progress events."""
