"""When automatic updates may run, and how often sources are scanned."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


@dataclass(frozen=True)
class Schedule:
    """kind: window, always or manual. days: 0 is Sunday. A window that ends before it starts wraps past midnight, but
    the day tested is the current one."""

    kind: str = "window"
    days: tuple[int, ...] = field(default=(1, 2, 3, 4, 5))
    start: int = 9
    end: int = 17
    zone: str | None = None

    def open_at(self, day: int, hour: int) -> bool:
        if self.kind != "window":
            return self.kind == "always"
        inside = (self.start <= hour < self.end) if self.start < self.end else (hour >= self.start or hour < self.end)
        return day in self.days and inside

    def active(self, now: datetime | None = None) -> bool:
        now = now or datetime.now(timezone.utc)
        if self.zone:
            try:
                now = now.astimezone(ZoneInfo(self.zone))
            except (ZoneInfoNotFoundError, ValueError):
                pass  # an unknown zone: the time as given
        return self.open_at((now.weekday() + 1) % 7, now.hour)

    def column(self, at: Column) -> Column:
        """active as an expression over UTC timestamps."""
        if self.kind != "window":
            return F.lit(self.kind == "always")
        local = F.from_utc_timestamp(at, self.zone) if self.zone else at
        hour = F.hour(local)
        inside = (hour >= self.start) & (hour < self.end) if self.start < self.end else (hour >= self.start) | (hour < self.end)
        return (F.dayofweek(local) - 1).isin(*self.days) & inside

    def label(self) -> str:
        if self.kind != "window":
            return {"always": "24/7", "manual": "Manual only"}[self.kind]
        named = [DAYS[d] for d in self.days]
        row = list(self.days) == list(range(self.days[0], self.days[0] + len(self.days)))
        days = "Every day" if len(named) == 7 else f"{named[0]}–{named[-1]}" if row and len(named) > 2 else ", ".join(named)
        hour = lambda h: f"{(h - 1) % 12 + 1} {'AM' if h % 24 < 12 else 'PM'}"
        return f"{days}, {hour(self.start)}–{hour(self.end)}"

    def stored(self) -> str:
        out = {"type": self.kind} | ({"days": list(self.days), "start_hour": self.start, "end_hour": self.end} if self.kind == "window" else {})
        return json.dumps(out | ({"timezone": self.zone} if self.zone else {}))


DEFAULT = Schedule()


def parse(value) -> Schedule | None:
    """From JSON text or a dict; None if it isn't a schedule."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    if not isinstance(value, dict):
        return None
    kind = value.get("type")
    if kind in ("always", "manual"):
        return Schedule(kind)
    try:
        days = tuple(sorted({int(d) for d in value.get("days") or () if float(d) == int(d) and 0 <= int(d) <= 6}))
        start, end = (int(value[k]) if float(value[k]) == int(value[k]) else -1 for k in ("start_hour", "end_hour"))
    except (KeyError, TypeError, ValueError):
        return None
    if kind != "window" or not days or not 0 <= start <= 23 or not 1 <= end <= 24 or start == end:
        return None
    zone = value.get("timezone")
    return Schedule("window", days, start, end, zone.strip() if isinstance(zone, str) and zone.strip() else None)


def parse_stored(value) -> Schedule:
    return parse(value) or DEFAULT


def scan_tier(rows: int, serverless: bool = False) -> int:
    """Minutes between scans, by the size of the source."""
    tier = 1 if rows < 1_000_000 else 2 if rows < 50_000_000 else 10
    return min(60, 10 * tier) if serverless else tier


def retuned_tier(scan_ms: float) -> int:
    return next((tier for most, tier in ((1000, 1), (5000, 2), (15000, 5)) if scan_ms < most), 10)


def backoff_minutes(failures: int) -> int:
    """Doubles with each failure, up to an hour."""
    return min(60, 2**failures)


PAUSE_AFTER = 5


def recheck_due(cycle: int, unhealthy_since: int) -> bool:
    """Whether an unhealthy source is looked at in this cycle: 2, 4, 8 and then every 10 cycles after it was found so."""
    waited, step, at = cycle - unhealthy_since, 2, 0
    while at < waited:
        at, step = at + step, min(10, 2 * step)
    return at == waited and waited > 0
