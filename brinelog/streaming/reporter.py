"""Figures about running streams: observed metrics, told at intervals."""

from __future__ import annotations

import logging
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "latency"


def observed(df: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """df, a stream, whose progress tells how many rows a micro-batch had and the quantiles of their latency."""
    q = lambda p, n: F.percentile_approx(latency, p, 10_000).alias(n)
    return df.observe(NAME, F.count(latency).alias("n"), q(0.5, "p50"), q(0.99, "p99"))


class Reporter(StreamingQueryListener):
    """Logs a summary of what observed() streams have told, at most once an interval and only if there were rows since the last one.

    p50 and p99 are those of the latest micro-batch with rows; alerts a minute count rows over window_s seconds of the driver's clock.
    """

    def __init__(self, interval_s: float, window_s: float = 60.0, log: Callable[[str], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.interval, self.window, self.clock = interval_s, window_s, clock
        self.log = log or logging.getLogger("brinelog.reporter").info
        self.began = self.last = clock()
        self.seen: deque[tuple[float, int]] = deque()
        self.fresh, self.p50, self.p99 = 0, 0.0, 0.0

    def uptime(self) -> float:
        return self.clock() - self.began

    def per_minute(self) -> float:
        now = self.clock()
        while self.seen and self.seen[0][0] < now - self.window:
            self.seen.popleft()
        return sum(n for _, n in self.seen) * 60.0 / self.window if self.window > 0 else 0.0

    def maybe_report(self) -> bool:
        """True if a summary was logged."""
        if not self.fresh or self.clock() - self.last < self.interval:
            return False
        self.last, self.fresh = self.clock(), 0
        self.log(f"Latency P50: {self.p50:.1f}ms | P99: {self.p99:.1f}ms | Alerts/min: {self.per_minute():.1f}")
        return True

    def told(self, n: int, p50: float | None, p99: float | None) -> None:
        if n:
            self.fresh, self.p50, self.p99 = self.fresh + n, float(p50), float(p99)
            self.seen.append((self.clock(), n))

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            self.told(row["n"], row["p50"], row["p99"])
        self.maybe_report()

    def onQueryIdle(self, event) -> None:
        self.maybe_report()

    def onQueryTerminated(self, event) -> None: ...
