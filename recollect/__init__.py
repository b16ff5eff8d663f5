"""Session-memory analytics as DataFrame transforms."""
