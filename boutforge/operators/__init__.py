"""operators of combat-record analytics."""
