"""Calls of model services: retry on rate limits, a bound on concurrent calls, a token account."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

T = TypeVar("T")
RATE_SECONDS = 60.0


def is_rate_limit(error: BaseException) -> bool:
    text = f"{type(error).__name__} {error}".lower()
    return any(mark in text for mark in ("ratelimit", "rate limit", "too many requests", "429"))


def with_retry(call: Callable[[], T], attempts: int = 6, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """``call()``, repeated on rate limits after pauses that double, with jitter; other errors pass at once, and
    so does the last rate limit."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            if attempt + 1 == attempts or not is_rate_limit(error):
                raise
            sleep(min(most, first * 2**attempt) + random.uniform(0, first))
    raise ValueError("at least one attempt is needed")


class Dispatcher:
    """Driver-side calls: at most ``concurrency`` at a time, retried, with the tokens of the last minute on account."""

    def __init__(self, concurrency: int = 1, **retry) -> None:
        self._gate, self._lock, self._retry = threading.Semaphore(concurrency), threading.Lock(), retry
        self._account: deque[tuple[float, int]] = deque()

    def run(self, call: Callable[[], T], tokens: int = 0) -> T:
        with self._gate:
            with self._lock:
                self._account.append((time.monotonic(), tokens))
            return with_retry(call, **self._retry)

    @property
    def tokens_per_minute(self) -> int:
        with self._lock:
            while self._account and time.monotonic() - self._account[0][0] > RATE_SECONDS:
                self._account.popleft()
            return sum(n for _, n in self._account)


def retried(model: Callable, **retry) -> Callable:
    """A model that repeats rate-limited calls, for use on executors."""
    return lambda *args: with_retry(lambda: model(*args), **retry)


def bounded(rows: DataFrame, concurrency: int | None) -> DataFrame:
    """At most ``concurrency`` tasks, and so calls, at a time."""
    return rows.coalesce(concurrency) if concurrency else rows
