"""What a function of the language sees."""

from __future__ import annotations

from dataclasses import dataclass

from meshset.model import Snapshot


@dataclass(frozen=True)
class Context:
    """The snapshot of the query, the one of the dependency graph, and the environment."""

    snapshot: Snapshot
    dependency: Snapshot
    env: str = ""
