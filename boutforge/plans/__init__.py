"""plans of combat-record analytics."""
