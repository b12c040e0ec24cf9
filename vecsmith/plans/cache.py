"""A bounded cache of small results: least recently used goes first, entries end after a time."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable


class ResultCache:
    """Keys should hold the version of what was read, so that a write never leaves an old result in use."""

    def __init__(self, entries: int = 1000, seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.held: OrderedDict = OrderedDict()
        self.lock = threading.Lock()

    def get(self, key: Hashable, default=None):
        """The value, whose time begins anew."""
        with self.lock:
            if key not in self.held or self.held[key][1] <= self.clock():
                self.held.pop(key, None)
                return default
            value = self.held.pop(key)[0]
            self.held[key] = (value, self.clock() + self.seconds)
            return value

    def set(self, key: Hashable, value) -> None:
        with self.lock:
            self.held.pop(key, None)
            self.held[key] = (value, self.clock() + self.seconds)
            while len(self.held) > self.entries:
                self.held.popitem(last=False)

    def remove(self, key: Hashable) -> bool:
        with self.lock:
            return self.held.pop(key, None) is not None

    def clear(self) -> None:
        with self.lock:
            self.held.clear()

    def __contains__(self, key: Hashable) -> bool:
        with self.lock:
            return key in self.held and self.held[key][1] > self.clock()

    def __len__(self) -> int:
        return len(self.held)
