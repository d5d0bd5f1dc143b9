"""sources of the triage engine."""
