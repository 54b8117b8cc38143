"""A bounded cache for per-word work: two generations of entries, the older dropped when the younger is full. Words in steady use move to the younger
one, so a task's memory stays bounded while frequent words stay cached."""

from __future__ import annotations


class Memo:
    def __init__(self, room: int = 250_000):
        self.room, self.young, self.old = room, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """The words that must be worked out; the others are in the younger generation afterwards."""
        out = []
        for w in words.difference(self.young):
            value = self.old.get(w)
            if value is None:
                out.append(w)
            else:
                self.young[w] = value
        return out

    def turn(self) -> None:
        """Start a new generation if the younger one is full. Call between texts only."""
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
