"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from storegrain.plans import audit, fetched, findings, landed, merchant, pages, products, streams

PARTS = (audit, pages, findings, products, merchant, fetched, landed, streams)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: q for part in PARTS for name, q in part.SQL.items()}
