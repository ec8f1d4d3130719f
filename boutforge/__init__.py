"""Combat-record analytics on Spark."""
