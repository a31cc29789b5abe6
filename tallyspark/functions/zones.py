"""Versioned zone transition tables as plain arrays, for vectorised wall-time conversion."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Years covered by the tables; instants outside use the nearest known offset.
FIRST_YEAR, LAST_YEAR = 1950, 2100
_STEP_S = 5 * 86_400


@dataclass(frozen=True)
class ZoneTable:
    """``offsets[k]`` (seconds) holds for wall times from ``walls[k-1]`` on; ``abbreviations`` maps an
    upper-case abbreviation to the offset it last stood for."""

    name: str
    walls: np.ndarray
    offsets: np.ndarray
    abbreviations: dict[str, int]

    def to_utc(self, wall_us: np.ndarray) -> np.ndarray:
        """Microseconds UTC of wall microseconds. A repeated wall time is its first occurrence; a
        skipped one moves forward by the gap: both mean the offset in force before the change."""
        k = np.searchsorted(self.walls, wall_us, side="right")
        return wall_us - self.offsets[k] * 1_000_000


def tzdata_version() -> str:
    """The release of the zone data that tables are built from, or 'unknown'."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    for root in ("/usr/share/zoneinfo",):
        head = Path(root, "tzdata.zi")
        if head.exists():
            return head.open().readline().removeprefix("# version ").strip()
    return "unknown"


def _state(zone: ZoneInfo, at: int) -> tuple[int, str]:
    local = (_EPOCH + timedelta(seconds=at)).astimezone(zone)
    return int(local.utcoffset().total_seconds()), local.tzname() or ""


@functools.lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable | None:
    """The table of an IANA zone, or None if there is no such zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:  # unknown names raise several kinds of error
        return None
    start = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    end = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    walls, offsets, before = [], [], _state(zone, start)
    offsets.append(before[0])
    names = {before[1].upper(): before[0]}
    at = start
    while at < end:
        after = _state(zone, at + _STEP_S)
        if after != before:
            low, high = at, at + _STEP_S
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _state(zone, mid) == before else (low, mid)
            after = _state(zone, high)
            if after[0] != before[0]:
                walls.append((high + max(before[0], after[0])) * 1_000_000)
                offsets.append(after[0])
            names[after[1].upper()] = after[0]
            before, at = after, high
        else:
            at += _STEP_S
    return ZoneTable(name, np.array(walls, np.int64), np.array(offsets, np.int64), names)
