"""All registered queries of the core."""

from __future__ import annotations

from verslog.plans import kv, problems, stores

QUERIES = {**kv.QUERIES, **stores.QUERIES, **problems.QUERIES}
ORACLE = {**kv.ORACLE, **stores.ORACLE, **problems.ORACLE}
