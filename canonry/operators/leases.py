"""Who may work on something now: a holder, until when, and a number that only grows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from .store import Change, Conflict, Snapshot, Store


class Lost(Conflict):
    """Someone else has taken the lease meanwhile."""


@dataclass(frozen=True)
class Lease:
    """fence: of two holders of one name the later has the higher."""

    name: str
    holder: str
    fence: int

    def check(self, now: Snapshot) -> None:
        """Called within a commit, so that what a stalled holder publishes late is refused."""
        held = now.marks(self.name)
        if (held.get("holder"), int(held.get("fence", 0))) != (self.holder, self.fence):
            raise Lost(f"{self.name} is held by {held.get('holder') or 'no one'}")


def take(store: Store, name: str, holder: str, now: datetime, lasts: timedelta) -> Lease | None:
    """The lease of a name, until now + lasts unless released before; None while another one's lasts."""
    got: Lease | None = None

    def change(state: Snapshot) -> Change | None:
        nonlocal got
        held = state.marks(name)
        if held.get("holder") and datetime.fromisoformat(held["until"]) > now:
            got = None
            return None
        got = Lease(name, holder, int(held.get("fence", 0)) + 1)
        return Change(marks={name: {"holder": holder, "fence": str(got.fence), "until": (now + lasts).isoformat()}})

    store.transact(change)
    return got


def release(store: Store, lease: Lease) -> None:
    """Nothing happens if it was lost."""

    def change(state: Snapshot) -> Change | None:
        try:
            lease.check(state)
        except Lost:
            return None
        return Change(marks={lease.name: {"holder": ""}})

    store.transact(change)


def holds(lease: Lease | None, change: Callable[[Snapshot], Change | None]) -> Callable[[Snapshot], Change | None]:
    """change, made only while the lease is held."""

    def checked(state: Snapshot) -> Change | None:
        if lease is not None:
            lease.check(state)
        return change(state)

    return checked
