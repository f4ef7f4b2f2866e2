"""DuckDB statements that state every registered query over the driver's tables.

Each entry of `PARTS` is the body of one common table expression; `statement` puts together
the ones a query needs. The texts state the definitions, not the Spark plans: payables, for
instance, go through outer joins here and may go through one grouping there.
"""

from __future__ import annotations

import re

from oracle.tables import TABLES
from oracle.workpapers import WORKPAPERS

PARTS: dict[str, str] = TABLES | WORKPAPERS


def _needed(name: str, seen: list[str]) -> None:
    for word in dict.fromkeys(re.findall(r"\w+", PARTS[name])):
        if word in PARTS and word != name and word not in seen:
            _needed(word, seen)
    if name not in seen:
        seen.append(name)


def statement(name: str, without_rows: tuple[str, ...] = ()) -> str:
    """SELECT over the named part, preceded by every part it refers to; the parts `without_rows` are empty."""
    parts: list[str] = []
    _needed(name, parts)
    bodies = {p: PARTS[p].strip() for p in parts}
    bodies |= {p: f"SELECT * FROM (\n{bodies[p]}\n) WHERE false" for p in without_rows if p in bodies}
    ctes = ",\n".join(f"{part} AS (\n{body}\n)" for part, body in bodies.items())
    return f"WITH {ctes}\nSELECT * FROM {name}"
