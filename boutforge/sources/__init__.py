"""sources of combat-record analytics."""
