"""Registered queries of the triage engine, one module for each family, with their SQL."""
