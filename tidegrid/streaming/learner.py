"""Online linear learner as a keyed stateful stream: predict, measure, test for drift, learn, row by row in time order."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidegrid.streaming.detectors import make_detector


class OnlineLinear:
    """Standardised inputs and a linear model trained by stochastic gradient steps on the squared loss."""

    def __init__(self, size: int, rate: float = 0.01, intercept_rate: float = 0.01, l2: float = 0.0, detector: str | None = "adwin", threshold: float | None = None):
        self.rate, self.intercept_rate, self.l2 = rate, intercept_rate, l2
        self.kind, self.threshold = detector, threshold
        self.n, self.late, self.last = 0, 0, None
        self.mean, self.m2, self.weight = [0.0] * size, [0.0] * size, [0.0] * size
        self.intercept = 0.0
        self.sums = [0.0, 0.0, 0.0, 0.0]  # |e|, e^2, running mean of y, sum of squares around it
        self.detector = make_detector(detector, threshold)

    def _scaled(self, x: Sequence[float]) -> list[float]:
        out = []
        for value, mean, m2 in zip(x, self.mean, self.m2):
            spread = math.sqrt(m2 / self.n) if self.n else 0.0
            out.append((value - mean) / spread if spread > 0 else 0.0)
        return out

    def predict(self, x: Sequence[float]) -> float:
        return self.intercept + sum(w * v for w, v in zip(self.weight, self._scaled(x)))

    def learn(self, x: Sequence[float], y: float) -> tuple[float, bool]:
        """Prediction made before the update, and whether drift was signalled."""
        predicted = self.predict(x)
        error = y - predicted
        ae, se, mean, spread = self.sums
        moved = mean + (y - mean) / (self.n + 1)
        self.sums = [ae + abs(error), se + error * error, moved, spread + (y - mean) * (y - moved)]
        drift = self.detector.update(abs(error)) if self.detector else False
        if drift:
            self.detector = make_detector(self.kind, self.threshold)
        self.n += 1
        for i, value in enumerate(x):
            step = value - self.mean[i]
            self.mean[i] += step / self.n
            self.m2[i] += step * (value - self.mean[i])
        scaled = self._scaled(x)
        slope = 2.0 * (self.intercept + sum(w * v for w, v in zip(self.weight, scaled)) - y)
        slope = max(-1e12, min(1e12, slope))
        self.weight = [w - self.rate * (slope * v + self.l2 * w) for w, v in zip(self.weight, scaled)]
        self.intercept -= self.intercept_rate * slope
        return predicted, drift

    def metrics(self) -> tuple[float, float, float | None]:
        n = self.n
        ae, se, _, spread = self.sums
        return ae / n, math.sqrt(se / n), (1 - se / spread if n > 1 and spread > 1e-9 else None)

    def dump(self) -> str:
        return json.dumps(
            [self.n, self.late, self.last, self.mean, self.m2, self.weight, self.intercept, self.sums, self.detector.dump() if self.detector else None]
        )

    def load(self, text: str) -> "OnlineLinear":
        (self.n, self.late, self.last, self.mean, self.m2, self.weight, self.intercept, self.sums, detector) = json.loads(text)
        if detector is not None:
            self.detector = make_detector(self.kind, self.threshold).load(detector)
        return self


MEASURES = "sample_number long, y_true double, y_pred double, mae double, rmse double, r2 double, drift int, late_rows long"


class InOrder(StatefulProcessor):
    """Learns the rows of a series in time order from panes of stored rows, so that a pane is all that is in memory.

    A chunk of rows is parted into panes that lie in the state store.  Without ``wait`` the panes of a batch are learned, oldest
    first, when its last chunk is stored; with it a pane is learned when the watermark has passed its end (timers come in order).
    """

    def __init__(self, names: Sequence[str], key: str, pane_us: int, wait: bool, settings: dict):
        self.names, self.key, self.pane_us, self.wait, self.settings = list(names), key, pane_us, wait, settings
        self.columns = [key, "learner_at", *[c.split()[0] for c in MEASURES.split(", ")]]

    def init(self, handle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "model string")
        self.panes = handle.getMapState("panes", "until long", "rows string")

    def _store(self, chunk: pd.DataFrame) -> set[int]:
        """Add a chunk to the stored panes; the ends of the panes it belongs to."""
        rows: dict[int, list] = {}
        for row in chunk[["learner_at", "learner_y", *self.names]].itertuples(index=False):
            at = int(row[0])
            rows.setdefault((at // self.pane_us + 1) * self.pane_us, []).append([at, *map(float, row[1:])])
        for until, more in rows.items():
            held = self.panes.getValue((until,)) if self.panes.containsKey((until,)) else None
            if held is None and self.wait:
                # a timer fires when the watermark is beyond it
                self.handle.registerTimer(until // 1000 - 1)
            self.panes.updateValue((until,), (json.dumps((json.loads(held[0]) if held else []) + more),))
        return set(rows)

    def _learned(self, name: str, until: int, model: OnlineLinear) -> pd.DataFrame:
        out = []
        for at, y, *x in sorted(json.loads(self.panes.getValue((until,))[0]), key=lambda r: (r[0], repr(r))):
            if model.last is not None and at <= model.last:
                model.late += 1
                continue
            if any(map(math.isnan, [y, *x])):
                continue
            predicted, drift = model.learn(x, y)
            model.last = at
            out.append((name, at, model.n, y, predicted, *model.metrics(), int(drift), model.late))
        self.panes.removeKey((until,))
        return pd.DataFrame(out, columns=self.columns)

    def _loaded(self) -> OnlineLinear:
        model = OnlineLinear(len(self.names), **self.settings)
        return model.load(self.model.get()[0]) if self.model.exists() else model

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: set[int] = set()
        for chunk in rows:
            found |= self._store(chunk)
        if found and not self.wait:
            yield from self._release(key[0], sorted(found))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key[0], [(expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000])

    def _release(self, name: str, panes: list[int]) -> Iterator[pd.DataFrame]:
        model = self._loaded()
        for until in panes:
            out = self._learned(name, until, model)
            if len(out):
                yield out
        self.model.update((model.dump(),))

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def online_learner(
    df: DataFrame,
    features: Sequence[str],
    target: str = "load",
    key: str = "series_id",
    ts: str = "timestamp",
    delay: str | None = None,
    pane_hours: int = 24,
    **settings,
) -> DataFrame:
    """Prequential predictions and drift flags of each row of a stream.

    The state of a series is a few numbers per feature, and panes of ``pane_hours`` with rows that wait.  A task holds the rows of
    one pane and one Arrow chunk, however many rows a batch or a series has.  By default the rows of a batch are learned at its
    end, in time order; those not newer than the last one learned are counted in ``late_rows`` and skipped.  With ``delay`` rows wait
    until the watermark (newest row less ``delay``) has passed their pane, so that rows of later batches which are at most that
    late take their place in the order; older rows are dropped by the watermark, the rows of open panes are not learned yet.
    Of rows with one timestamp one is learned.  Rows without key, timestamp, target or a feature are left out.
    """
    # a name that begins with an underscore does not reach the rows
    spark, names = df.sparkSession, [f"learner_x{i}" for i in range(len(features))]
    # state of several kinds per key, timers included, needs this store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = df.withWatermark(ts, delay) if delay else df
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in (target, *features)]
    ready = timed.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias(key), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("learner_at"), *[v.alias(n) for v, n in zip(values, ["learner_y", *names])]
    )
    processor = InOrder(names, key, pane_hours * 3_600_000_000, bool(delay), settings)
    mode = "EventTime" if delay else "None"
    learned = ready.groupBy(key).transformWithStateInPandas(processor, f"`{key}` string, learner_at long, {MEASURES}", "Append", mode)
    return learned.select(key, F.timestamp_micros("learner_at").alias(ts), *[c.split()[0] for c in MEASURES.split(", ")])
