"""Registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import media, tabular

QUERIES: dict = {**tabular.QUERIES, **media.QUERIES}
ORACLE_SQL: dict[str, str] = {**tabular.ORACLE_SQL, **media.ORACLE_SQL}
