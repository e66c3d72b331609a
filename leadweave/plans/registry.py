"""All registered queries of the lead operators."""

from __future__ import annotations

from leadweave.plans import extra, facts, more, queries
from leadweave.shipping import shipped

QUERIES = {k: shipped(f) for k, f in {**queries.QUERIES, **facts.QUERIES, **more.QUERIES, **extra.QUERIES}.items()}
ORACLE_SQL = {**queries.ORACLE_SQL, **facts.ORACLE_SQL, **more.ORACLE_SQL, **extra.ORACLE_SQL}
