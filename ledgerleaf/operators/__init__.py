"""operators of the triage engine."""
