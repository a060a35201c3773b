"""Event-time windows over tables and streams."""
