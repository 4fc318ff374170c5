"""Cursors over the nodes of a snapshot in the order of their names.

A cursor holds a name, not a place in a result: each move is a filter on the
name and a top-n, so it stays valid over versions and costs one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshset.model import Snapshot


def page(snap: Snapshot, n: int, after: str | None = None, before: str | None = None) -> DataFrame:
    """(name, type) of the ``n`` nodes next to a name; those before it come nearest first."""
    rows = snap.nodes
    if after is not None:
        rows = rows.where(F.col("name") > after)
    if before is not None:
        rows = rows.where(F.col("name") < before)
    return rows.orderBy(F.col("name").asc() if before is None else F.col("name").desc()).limit(n)


class Cursor:
    """Moves over names; a move beyond an end gives None and leaves the cursor where it was."""

    def __init__(self, snap: Snapshot):
        self.snap, self.at = snap, None

    def _move(self, rows: DataFrame, n: int) -> str | None:
        found = rows.collect()
        if len(found) < n:
            return None
        self.at = found[-1].name
        return self.at

    def first(self) -> str | None:
        return self._move(page(self.snap, 1), 1)

    def last(self) -> str | None:
        return self._move(self.snap.nodes.orderBy(F.desc("name")).limit(1), 1)

    def next(self, n: int = 1) -> str | None:
        return self._move(page(self.snap, n, after=self.at), n)

    def prev(self, n: int = 1) -> str | None:
        return None if self.at is None else self._move(page(self.snap, n, before=self.at), n)

    def fetch(self, name: str) -> str | None:
        """Go to a node by name."""
        return self._move(self.snap.nodes.where(F.col("name") == name), 1)
