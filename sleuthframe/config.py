"""Correlation and anomaly settings with the range checks of the settings form."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    time: float = 0.30
    entity: float = 0.35
    source: float = 0.15
    event: float = 0.20

    def __post_init__(self):
        for name in ("time", "entity", "source", "event"):
            value = getattr(self, name)
            if not isinstance(value, (int, float)) or not 0.0 <= value <= 1.0:
                raise ValueError(f"weight '{name}' must be between 0.0 and 1.0, got {value!r}")

    @property
    def total(self) -> float:
        return (self.time + self.entity + self.source + self.event) or 1.0


@dataclass(frozen=True)
class Settings:
    weights: Weights = field(default_factory=Weights)
    window_seconds: int = 3600
    anomaly_threshold: float = 0.80
    timezone: str = "UTC"
    cross_case: bool = True
    min_score: float = 0.15
    #: rows are near in time if they lie in one anchored bucket, not if they are less than a window apart
    anchored: bool = False

    def __post_init__(self):
        if int(self.window_seconds) != self.window_seconds or self.window_seconds <= 0:
            raise ValueError("window_seconds must be a positive whole number")
        if not 0.0 <= self.anomaly_threshold <= 1.0:
            raise ValueError("anomaly_threshold must be between 0.0 and 1.0")
        if not 0.0 <= self.min_score <= 1.0:
            raise ValueError("min_score must be between 0.0 and 1.0")

    @property
    def window_micros(self) -> int:
        return self.window_seconds * 1_000_000


DEFAULT = Settings()
