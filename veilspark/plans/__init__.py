"""Registered queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import context, detection, files, findings, matching, more, protection, scoring, streams

_PARTS = (detection, findings, protection, context, scoring, more, streams, files, matching)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
flagship = streams.flagship
