"""Reading and writing stage tables, and the check-in view over raw events."""
