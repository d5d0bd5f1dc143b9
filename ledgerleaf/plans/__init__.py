"""plans of the triage engine."""
