"""Limits and thresholds of geocoding."""

from __future__ import annotations

from dataclasses import dataclass

#: Bytes, as counted in the table, up to which a lookup table is broadcast; beyond them
#: Spark deals both sides out (and splits skewed keys as it runs).
BROADCAST_BYTES = 192 << 20


@dataclass(frozen=True)
class Config:
    machiaza_confidence: float = 0.30
    banchi_confidence: float = 0.30
    present_threshold: float = 0.50
    max_options: int = 255  # with the option "none of these"
    always_ask: bool = False
    batch_size: int = 64
    concurrency: int = 4  # requests to the model under way at once, over the whole cluster
    request_tasks: int = 8  # tasks that share them, each with a pool of threads
    narrow_by_oaza: bool = True
    narrow_max_machiaza: int = 20_000
    narrow_token_budget: int = 48_000
    narrow_inputs_per_request: int = 1

    def __post_init__(self):
        if not 2 <= self.max_options <= 255:
            raise ValueError("max_options must lie between 2 and 255")
        if min(self.batch_size, self.concurrency, self.request_tasks) < 1:
            raise ValueError("batch_size, concurrency and request_tasks must be at least 1")

    @property
    def max_candidates(self) -> int:
        return self.max_options - 1

    @property
    def ceiling(self) -> int:
        """Towns of a city beyond which the whole city isn't put to the model."""
        return self.narrow_max_machiaza if self.narrow_by_oaza else self.max_candidates
