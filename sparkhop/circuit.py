"""Circuit breaker for calls to outside catalogs and stores."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import TypeVar

from .errors import CircuitOpen

T = TypeVar("T")


class State(Enum):
    CLOSED = "closed"
    OPEN = "open"
    HALF_OPEN = "half-open"


@dataclass(frozen=True)
class BreakerConfig:
    failures_to_open: int = 5
    reset_seconds: float = 30.0
    successes_to_close: int = 2


class CircuitBreaker:
    """Closed until enough failures in a row; open until the reset time is over;
    then half-open, where one failure opens it and enough successes close it."""

    def __init__(self, config: BreakerConfig | None = None, clock: Callable[[], float] = time.monotonic):
        self.config, self._clock, self._lock = config or BreakerConfig(), clock, threading.Lock()
        self._state, self._failures, self._successes, self._failed_at = State.CLOSED, 0, 0, 0.0

    @property
    def state(self) -> State:
        return self._state

    @property
    def failure_count(self) -> int:
        return self._failures

    def check(self) -> None:
        with self._lock:
            if self._state is State.OPEN:
                if self._clock() - self._failed_at < self.config.reset_seconds:
                    raise CircuitOpen()
                self._state, self._successes = State.HALF_OPEN, 0

    def record_success(self) -> None:
        with self._lock:
            if self._state is State.HALF_OPEN:
                self._successes += 1
                if self._successes < self.config.successes_to_close:
                    return
                self._state = State.CLOSED
            if self._state is State.CLOSED:
                self._failures = 0

    def record_failure(self) -> None:
        with self._lock:
            if self._state is State.OPEN:
                return
            self._failures += 1
            self._failed_at = self._clock()
            if self._state is State.HALF_OPEN or self._failures >= self.config.failures_to_open:
                self._state = State.OPEN

    def reset(self) -> None:
        with self._lock:
            self._state, self._failures, self._successes = State.CLOSED, 0, 0

    def call(self, action: Callable[[], T]) -> T:
        """Runs the action under the breaker."""
        self.check()
        try:
            out = action()
        except Exception:
            self.record_failure()
            raise
        self.record_success()
        return out
