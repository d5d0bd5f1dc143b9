"""streaming of the triage engine."""
