"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from cairnset.plans import dealt, merging, mining, ranked, reads, streams

MODULES = [dealt, ranked, reads, merging, mining, streams]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
