"""All registered queries of the triage engine and their SQL."""

from __future__ import annotations

from .queries import relational, text

QUERIES: dict = {**text.QUERIES, **relational.QUERIES}
ORACLES: dict = {**text.ORACLES, **relational.ORACLES}
