"""Registered queries by name, and the SQL that states the same result."""

from __future__ import annotations

from sluicebox.plans import files, images, tables, vectors

QUERIES: dict = {**vectors.QUERIES, **images.QUERIES, **files.QUERIES, **tables.QUERIES}
ORACLE_SQL: dict = {**vectors.ORACLE_SQL, **images.ORACLE_SQL, **files.ORACLE_SQL, **tables.ORACLE_SQL}
