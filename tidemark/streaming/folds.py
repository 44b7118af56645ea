"""Order-dependent decisions as small state machines, shared by the streams and their batch twins.

A fold has `start()` giving the state as a list of integers and `step(state, row)` giving (state, outputs).
States stay short: admitted times within the hour, or a counter. Times are microseconds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class AlertFold:
    """Suppress an alert while an admitted one is younger than the window, then hold to a cap per hour.

    A suppressed alert also forgets admitted times older than the window.
    """
    window_us: int = 300_000_000
    cap: int = 20

    def start(self):
        return []

    def step(self, held, row):
        now = row["ts_us"]
        young = held[bisect_right(held, now - self.window_us):]
        if young:
            return young, (False, f"dedup:{len(young)}in_window")
        within_hour = held[bisect_right(held, now - HOUR_US):]
        if len(within_hour) >= self.cap:
            return within_hour, (False, "hourly_cap")
        return within_hour + [now], (True, "ok")


@dataclass(frozen=True)
class RateFold:
    """Accept while fewer than `cap` accepted rows lie in the trailing span (its start included)."""
    cap: int = 100
    span_us: int = HOUR_US

    def start(self):
        return []

    def step(self, held, row):
        held = held[bisect_left(held, row["ts_us"] - self.span_us):]
        if len(held) >= self.cap:
            return held, (False, f"rate_limited:{len(held)}/{self.cap}per_hour")
        return held + [row["ts_us"]], (True, "ok")


@dataclass(frozen=True)
class QuotaFold:
    """All-or-nothing take of n within the allowance of a day; refused takes use nothing. State: day, used."""
    per_day: int = 500

    def start(self):
        return [-1, 0]

    def step(self, state, row):
        used = state[1] if state[0] == row["day"] else 0
        fits = used + row["n"] <= self.per_day
        used += row["n"] if fits else 0
        return [row["day"], used], (bool(fits), int(used))
