"""Retries for reads that may fail for a moment, and a record of scenes that were dropped."""

from __future__ import annotations

import random
import sys
import time
from collections.abc import Callable, Iterable
from typing import TypeVar

T = TypeVar("T")

#: Errors in the program are never retried.
PROGRAMMING = (TypeError, AttributeError, NameError, KeyError, IndexError, AssertionError, NotImplementedError)


class SceneFetchError(RuntimeError):
    """A scene could not be read after all attempts."""

    def __init__(self, scene: str, reason: str):
        super().__init__(f"scene {scene}: {reason}")
        self.scene, self.reason = scene, reason


def backoff(attempt: int, base: float = 0.5, cap: float = 8.0, jitter: float = 0.25) -> float:
    """Seconds before the next attempt (from 0): doubling, capped, spread by a quarter."""
    return min(cap, base * 2**attempt) * (1 + random.uniform(-jitter, jitter))


def retried(read: Callable[[], T], attempts: int = 4, reopen: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of ``read``, tried again after errors other than the program's own."""
    for n in range(attempts):
        try:
            return read()
        except PROGRAMMING:
            raise
        except Exception:
            if n == attempts - 1:
                raise
            sleep(backoff(n))
            if reopen is not None:
                reopen()
    raise AssertionError("unreachable")


def fetch_scene(scene: str, read: Callable[[], T], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> T:
    """As ``retried``, with the last error as a SceneFetchError."""
    try:
        return retried(read, attempts, sleep=sleep)
    except PROGRAMMING:
        raise
    except Exception as e:
        raise SceneFetchError(scene, f"{type(e).__name__}: {e}") from e


def report_dropped(dropped: Iterable[SceneFetchError], out=None) -> list[dict[str, str]]:
    """Say which scenes are missing and why; the list goes into the sidecar."""
    rows = [{"id": d.scene, "reason": d.reason} for d in dropped]
    for row in rows:
        print(f"dropped scene {row['id']}: {row['reason']}", file=out or sys.stderr)
    return rows
