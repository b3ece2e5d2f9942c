"""Job parameters (the reference's configuration values), checked to be positive."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class JobParams:
    # Fixed default values of the reference service (all durations in milliseconds).
    location_ttl_ms: int = 30_000
    location_sweep_ms: int = 10_000
    batch_size: int = 100
    batch_interval_ms: int = 500
    channel_ttl_ms: int = 300_000
    channel_sweep_ms: int = 60_000
    channel_buffer: int = 128
    # Grid origin of the sweep timers (first sweep at origin + one interval).
    origin_ms: int = 0
    # Width of the time chunks used to split one key's history over many tasks.
    chunk_ms: int = 3_600_000

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "origin_ms":
                if v < 0:
                    raise ValueError(f"{f.name} must be >= 0, got {v}")
            elif v <= 0:
                raise ValueError(f"{f.name} must be > 0, got {v}")

    @property
    def location_ttl_whole_s_ms(self) -> int:
        """The store truncates its ttl to whole seconds before comparing."""
        return (self.location_ttl_ms // 1000) * 1000
