"""Calls to the outside that may fail for a while."""

from __future__ import annotations

import time
from collections.abc import Callable


class Retry(Exception):
    """Raised by a provider for a failure worth another try; after: seconds the other side asked to wait."""

    def __init__(self, message: str = "", after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def with_retries(call: Callable, tries: int = 8, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Doubling waits between tries, never shorter than the other side asks for; the last failure is raised."""

    def run(*args):
        for attempt in range(tries):
            try:
                return call(*args)
            except Retry as e:
                if attempt == tries - 1:
                    raise
                sleep(max(e.after or 0.0, base * 2**attempt))

    return run
