"""Type classes, patterns and default assertions."""
