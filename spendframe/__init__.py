"""Cloud-spend analytics as plain DataFrame jobs."""
