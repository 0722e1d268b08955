"""A result that is kept for a while, so that a page that is asked for often is worked out once in that time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

TTL_SECONDS = 600


class Remembered:
    """A DataFrame that is made again when it is older than ``ttl`` seconds or when that is forced."""

    def __init__(self, make: Callable[[], DataFrame], ttl: float = TTL_SECONDS) -> None:
        self.make, self.ttl = make, ttl
        self.at: float | None = None
        self.found: DataFrame | None = None

    def get(self, now: float, force: bool = False) -> DataFrame:
        """The result as of ``now`` (seconds); the one before is released."""
        if force or self.found is None or now - self.at >= self.ttl:
            if self.found is not None:
                self.found.unpersist()
            self.found, self.at = self.make().cache(), now
        return self.found
