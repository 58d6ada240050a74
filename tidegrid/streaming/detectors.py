"""Change detectors kept in the state of the online learner: ADWIN (Bifet & Gavalda 2007) and Page-Hinkley."""

from __future__ import annotations

import math


class PageHinkley:
    """Signals when the faded sum of deviations above the running mean leaves its minimum by ``threshold``."""

    def __init__(self, threshold: float = 50.0, delta: float = 0.005, fade: float = 0.9999, warm_up: int = 30):
        self.threshold, self.delta, self.fade, self.warm_up = threshold, delta, fade, warm_up
        self.n, self.mean, self.total, self.low = 0, 0.0, 0.0, 0.0

    def update(self, x: float) -> bool:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        self.total = self.fade * self.total + (x - self.mean - self.delta)
        self.low = min(self.low, self.total)
        return self.n >= self.warm_up and self.total - self.low > self.threshold

    def dump(self) -> list:
        return [self.n, self.mean, self.total, self.low]

    def load(self, state: list) -> "PageHinkley":
        self.n, self.mean, self.total, self.low = state
        return self


class Adwin:
    """Adaptive window over an exponential histogram: at most ``per_level`` buckets for each power of two.

    A bucket is [count, sum, sum of squared deviations]; buckets are kept from oldest to newest.  The older part is
    dropped while the means of two adjoining parts differ by more than the bound for confidence ``delta``.
    """

    def __init__(self, delta: float = 0.002, per_level: int = 5, every: int = 32, smallest: int = 5):
        self.delta, self.per_level, self.every, self.smallest = delta, per_level, every, smallest
        self.buckets: list[list[float]] = []
        self.seen = 0

    @property
    def width(self) -> int:
        return int(sum(b[0] for b in self.buckets))

    @property
    def mean(self) -> float:
        n = self.width
        return sum(b[1] for b in self.buckets) / n if n else 0.0

    def _merge(self) -> None:
        size = 1
        while True:
            same = [i for i, b in enumerate(self.buckets) if b[0] == size]
            if len(same) <= self.per_level:
                return
            i = same[0]
            (n1, s1, v1), (n2, s2, v2) = self.buckets[i], self.buckets[i + 1]
            gap = s1 / n1 - s2 / n2
            self.buckets[i : i + 2] = [[n1 + n2, s1 + s2, v1 + v2 + gap * gap * n1 * n2 / (n1 + n2)]]
            size *= 2

    def _variance(self) -> float:
        n, mean = self.width, self.mean
        within = sum(b[2] for b in self.buckets)
        between = sum(b[0] * (b[1] / b[0] - mean) ** 2 for b in self.buckets)
        return (within + between) / n if n else 0.0

    def _cut(self) -> bool:
        n = self.width
        if n < 2 * self.smallest:
            return False
        total, variance = sum(b[1] for b in self.buckets), self._variance()
        confidence = math.log(2.0 * math.log(max(n, 3)) / self.delta)
        n0 = s0 = 0.0
        for b in self.buckets[:-1]:
            n0, s0 = n0 + b[0], s0 + b[1]
            n1, s1 = n - n0, total - s0
            if n0 < self.smallest or n1 < self.smallest:
                continue
            m = 1.0 / (1.0 / (n0 - self.smallest + 1) + 1.0 / (n1 - self.smallest + 1))
            bound = math.sqrt(2.0 / m * variance * confidence) + 2.0 / (3.0 * m) * confidence
            if abs(s0 / n0 - s1 / n1) > bound:
                return True
        return False

    def update(self, x: float) -> bool:
        self.seen += 1
        self.buckets.append([1, x, 0.0])
        self._merge()
        changed = False
        if self.seen % self.every == 0:
            while len(self.buckets) > 1 and self._cut():
                self.buckets.pop(0)
                changed = True
        return changed

    def dump(self) -> list:
        return [self.seen, self.buckets]

    def load(self, state: list) -> "Adwin":
        self.seen, self.buckets = state
        return self


def make_detector(kind: str | None, threshold: float | None = None):
    if kind == "adwin":
        return Adwin(0.002 if threshold is None else threshold)
    if kind == "page_hinkley":
        return PageHinkley(50.0 if threshold is None else threshold)
    if kind is None:
        return None
    raise ValueError(f"unknown detector: {kind}")
