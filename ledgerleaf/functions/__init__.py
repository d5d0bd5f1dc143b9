"""functions of the triage engine."""
