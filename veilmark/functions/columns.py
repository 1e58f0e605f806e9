"""Names of helper columns that do not meet a user's."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
