"""Settings of a graph: event-time watermark and tumbling windows."""

from __future__ import annotations

from dataclasses import dataclass

UNITS = ("seconds", "minutes", "hours", "days")


@dataclass(frozen=True)
class WindowSpec:
    """Tumbling window, aligned to the epoch."""

    value: int = 10
    unit: str = "seconds"

    def __post_init__(self) -> None:
        if isinstance(self.value, bool) or not isinstance(self.value, int) or self.value <= 0:
            raise ValueError(f"window value must be a positive whole number, not {self.value!r}")
        if self.unit not in UNITS:
            raise ValueError(f"window unit must be one of {', '.join(UNITS)}, not {self.unit!r}")

    @property
    def interval(self) -> str:
        return f"{self.value} {self.unit}"


@dataclass(frozen=True)
class GraphConfig:
    """``watermark_delay``: how late a row of a stream may be; bounded input ignores it."""

    watermark_delay: str = "10 seconds"
