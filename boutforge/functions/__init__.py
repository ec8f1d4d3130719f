"""functions of combat-record analytics."""
