"""All queries of the library by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.plans import evaluated, layered, modelled, ordered, relational, stateful

flagship = layered.flagship

QUERIES = {**layered.QUERIES, **relational.QUERIES, **ordered.QUERIES, **evaluated.QUERIES, **modelled.QUERIES, **stateful.QUERIES}
ORACLE_SQL = {**layered.ORACLE_SQL, **relational.ORACLE_SQL, **ordered.ORACLE_SQL, **evaluated.ORACLE_SQL, **modelled.ORACLE_SQL, **stateful.ORACLE_SQL}
