"""Tunable parameters. All durations are integer microseconds."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

SECOND_US = 1_000_000
DAY_US = 86_400 * SECOND_US


@dataclass(frozen=True)
class WindowConfig:
    """Sliding window grid. ``slide_us == size_us`` gives tumbling windows."""

    size_us: int = 3 * SECOND_US
    slide_us: int = 1 * SECOND_US
    # Grid origin; None means the first packet of the input
    origin_us: int | None = None

    @property
    def pane_us(self) -> int:
        """Largest pane width that tiles the window, the slide and one second."""
        return gcd(gcd(self.size_us, self.slide_us), SECOND_US)

    @property
    def seconds(self) -> int:
        """Number of one-second buckets that a window touches."""
        return -(-self.size_us // SECOND_US)


@dataclass(frozen=True)
class FlowConfig:
    """Flow cutting. ``active_us=None`` disables the active timeout."""

    idle_us: int = 15 * SECOND_US
    active_us: int | None = 120 * SECOND_US
    splt_length: int = 30
    max_samples: int = 5
    sample_bytes: int = 512
    hello_bytes: int = 16_384

    @property
    def bucket_us(self) -> int:
        """Time-bucket width of the skew-safe flow cut: shorter than both timeouts, so that a bucket
        never holds an idle gap and holds at most one active cut."""
        limit = self.idle_us if self.active_us is None else min(self.idle_us, self.active_us)
        return max(1, limit // 3)


@dataclass(frozen=True)
class FloodConfig:
    pps_threshold: float = 300.0
    min_packets: int = 200


@dataclass(frozen=True)
class ScanConfig:
    min_ports: int = 10
    min_hosts: int = 20
    min_probe_ratio: float = 0.6


@dataclass(frozen=True)
class CooldownConfig:
    cooldown_us: int = 30 * SECOND_US


@dataclass(frozen=True)
class DetectionConfig:
    """Everything a detection run needs, with the production defaults."""

    window: WindowConfig = WindowConfig()
    flow: FlowConfig = FlowConfig()
    flood: FloodConfig = FloodConfig()
    scan: ScanConfig = ScanConfig()
    cooldown: CooldownConfig = CooldownConfig()
    flow_threshold: float = 0.85
    host_threshold: float = 0.85
