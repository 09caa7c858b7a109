"""Event tables, stored objects and compressed blocks."""
