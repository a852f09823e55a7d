"""Column -> Column helpers. Nothing in here starts a job."""
