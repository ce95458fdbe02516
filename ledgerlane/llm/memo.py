"""A bounded memory of recent results for repeated words."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """Results of ``compute`` (a list of keys to a list of values) by key.

    Two generations of at most ``size`` keys: when the young one is full it
    becomes the old one, whose keys are forgotten unless they come up again.
    """

    def __init__(self, compute: Callable[[list], list], size: int = 300_000):
        self.compute, self.size = compute, size
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: list) -> list:
        """The results of distinct keys."""
        young, old = self.young, self.old
        if len(young) + len(keys) > self.size and young:
            self.old = old = young
            self.young = young = {}
        found = [young.get(key) for key in keys]
        missing = []
        for place, value in enumerate(found):
            if value is None:
                key = keys[place]
                value = old.get(key)
                if value is None:
                    missing.append(place)
                else:
                    young[key] = found[place] = value
        if missing:
            for place, value in zip(missing, self.compute([keys[place] for place in missing])):
                young[keys[place]] = found[place] = value
        return found
