"""Every query of the library itself, by name, with its oracle where SQL can express it."""

from __future__ import annotations

from lathework.plans import audit, detection, records, timeline

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (audit, timeline, detection, records):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
