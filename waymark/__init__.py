"""waymark: schedule-and-movement analytics on PySpark."""
