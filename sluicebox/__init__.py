"""Spark-native curation of media catalogues, vectors and ordered sequences."""

from sluicebox.session import session, table

__all__ = ["session", "table"]
