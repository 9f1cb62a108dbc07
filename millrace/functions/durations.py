"""Durations as text: ``10ms``, ``0.2s``, ``50Hz``, a bare number of nanoseconds."""

from __future__ import annotations

import re

#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "": 1}


def nanoseconds(text: str | int) -> int:
    """Nanoseconds of a duration, or of the period of a rate in Hz."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*", str(text))
    if not m:
        raise ValueError(f"no duration: {text!r}")
    number, unit = float(m[1]), m[2]
    if unit.lower() == "hz":
        if not number:
            raise ValueError("a rate of 0 Hz has no period")
        return round(1e9 / number)
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return round(number * UNITS[unit])
