"""Parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MapParams:
    """How alignments become contacts.  None switches a limit off; ``strong`` 0 or None means mapping quality alone."""

    min_mapq: int = 60
    strong: int | None = 10
    min_insert: int | None = None
    min_len: int = 1000
    min_sig: int = 5
    min_extent: int = 50_000
    max_image: int = 4000
    bin_size: int | None = None
    tip_size: int | None = None


@dataclass(frozen=True)
class SplitParams:
    size: int = 10_000
    threshold: float = 0.333
