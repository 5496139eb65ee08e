"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import cleaning, merging, models, windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (windows, cleaning, merging, models):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
