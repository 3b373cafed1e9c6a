"""Rates such as 250/s, 8 per minute, 1200/hour or a bare number, and what a stream attains of them."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

# Seconds of each unit.
UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400}


def parse(text: str | float) -> float:
    """Records a second."""
    if isinstance(text, (int, float)):
        rate = float(text)
    else:
        m = re.fullmatch(r"\s*([\d_.]+)\s*(?:(?:/|per)\s*([A-Za-z]+))?\s*", text)
        unit = (m[2] or "s").lower() if m else ""
        unit = unit if unit in UNITS else unit.rstrip("s")
        if not m or unit not in UNITS:
            raise ValueError(f"{text!r} is not a rate")
        rate = float(m[1].replace("_", "")) / UNITS[unit]
    if rate <= 0:
        raise ValueError(f"a rate must be above 0, not {text!r}")
    return rate


@dataclass
class Bucket:
    """Tokens that grow at a rate up to a ceiling; `due` takes the whole ones."""

    rate: float
    burst: float = 1.0
    tokens: float = 0.0
    last: float | None = None
    expected: float = 0.0
    taken: int = 0
    clock: object = field(default=time.monotonic, repr=False)

    @property
    def ceiling(self) -> float:
        return max(1.0, self.rate * self.burst)

    def due(self, most: int | None = None) -> int:
        now = self.clock()
        passed = 0.0 if self.last is None else now - self.last
        self.last = now
        self.expected += passed * self.rate
        self.tokens = min(self.ceiling, self.tokens + passed * self.rate)
        n = int(self.tokens) if most is None else min(int(self.tokens), most)
        self.tokens -= n
        self.taken += n
        return n

    def retarget(self, rate: float) -> None:
        self.rate = rate
        self.tokens = min(self.tokens, self.ceiling)

    @property
    def attainment(self) -> float:
        """What was taken against the integral of the targets."""
        return self.taken / self.expected if self.expected > 0 else 1.0
