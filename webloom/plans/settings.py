"""Settings of a crawl, frozen before it starts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from webloom.operators.middleware import merge_settings


@dataclass(frozen=True)
class Settings:
    """max_hops: most hops of one call of run, None for as many as it takes. until: the time (in seconds of the crawl) up to which
    recrawls go on; None: they stay pending, and a run ends when nothing else is left."""

    max_tries: int = 3
    max_hops: int | None = None
    until: float | None = None
    batch: int = 0
    max_requests_per_host: int | None = None
    max_requests_special_host: dict[str, int] = field(default_factory=dict)
    download_delay: float = 0.0
    download_delay_special_host: dict[str, float] = field(default_factory=dict)
    status_allowed: list[int] | None = None
    request_config: dict[str, Any] = field(default_factory=dict)
    log_period: str = "60 seconds"

    @classmethod
    def of(cls, *levels: dict[str, Any]) -> Settings:
        """Later levels count; unknown names are an error."""
        merged = {k.lower(): v for k, v in merge_settings(*levels).items()}
        known = {f.name for f in fields(cls)}
        if unknown := set(merged) - known:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        return cls(**merged)
