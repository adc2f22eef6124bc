"""Names for temporary columns."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], stem: str) -> str:
    """A column name that isn't among ``taken`` in any case."""
    lower = {c.lower() for c in taken}
    name, n = f"__{stem}", 0
    while name.lower() in lower:
        n += 1
        name = f"__{stem}{n}"
    return name
