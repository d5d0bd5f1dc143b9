"""Document triage, ledger analytics and corpus preparation as Spark DataFrame transforms."""
