"""streaming of combat-record analytics."""
