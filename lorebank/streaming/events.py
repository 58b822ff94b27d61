"""An event bus: callables that hear of every change, in the order they came.

Publishing is synchronous, and a subscriber's error is the publisher's. ``sink`` makes a bus the sink of
a stream, where subscribers get each micro-batch as a DataFrame.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame

Subscriber = Callable[[str, object], None]


class EventBus:
    def __init__(self):
        self._numbers, self._subscribers = itertools.count(1), {}

    def subscribe(self, subscriber: Subscriber, kinds: tuple[str, ...] = ()) -> int:
        """The number of a subscription to some kinds of events, or to all."""
        number = next(self._numbers)
        self._subscribers[number] = (subscriber, frozenset(kinds))
        return number

    def unsubscribe(self, number: int) -> bool:
        return self._subscribers.pop(number, None) is not None

    def publish(self, kind: str, payload: object) -> int:
        """Tell every subscriber to that kind; how many there were."""
        told = [s for s, kinds in self._subscribers.values() if not kinds or kind in kinds]
        for subscriber in told:
            subscriber(kind, payload)
        return len(told)

    def sink(self, kind: str) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``; the payload is the batch and its number."""
        return lambda batch, number: self.publish(kind, (batch, number)) and None
