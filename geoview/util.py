"""Timers for steps of a driver program, and a mark for unfinished functions."""

from __future__ import annotations

import functools
import logging
import time
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@contextmanager
def step(logger: logging.Logger, name: str) -> Iterator[None]:
    """Logs a step's start and its milliseconds, and how it ended."""
    logger.info("%s ...", name)
    start = time.perf_counter()
    try:
        yield
    except BaseException:
        logger.error("%s failed after %.0f ms", name, (time.perf_counter() - start) * 1e3)
        raise
    logger.info("%s took %.0f ms", name, (time.perf_counter() - start) * 1e3)


@dataclass
class TimeTracker:
    """Milliseconds by name, added up over uses."""

    times: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def track(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.times[name] = self.times.get(name, 0.0) + (time.perf_counter() - start) * 1e3

    @property
    def total(self) -> float:
        return sum(self.times.values())


def incomplete(what: str) -> Callable[[Callable], Callable]:
    """Warns, when the function is called, of what it lacks."""

    def mark(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            warnings.warn(f"{f.__name__}: {what}", stacklevel=2)
            return f(*args, **kwargs)

        return call

    return mark
