"""The adaptive miss rate on a stream: intervals and the level path, kept as state between batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paneltide.operators.conformal import DELAY, LEAST, WINDOW

OUT = "config string, code string, i bigint, lower double, upper double, alpha_D double, n_calib bigint, quality_flag string"


class Levels(StatefulProcessor):
    """State of one configuration: the level, and the rows of the last ``delay + window`` days.

    Rows are kept as they come, under their day. A timer at the day's time fires once the watermark has passed it, so that a day is
    decided when all its rows and all labels that matured with it are there, in whatever order they came; days are decided in their
    order, since timers of one batch are sorted. Days that no later decision can read are removed.
    """

    def __init__(self, targets: dict[str, float], gamma: float, least: int, window: int, delay: int, low: float = 0.02, high: float = 0.5):
        self.targets, self.gamma, self.least, self.window, self.delay, self.low, self.high = targets, gamma, least, window, delay, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "alpha double")
        self.forecasts = handle.getMapState("forecasts", "i bigint", "code array<string>, q10 array<double>, q90 array<double>, lower array<double>, upper array<double>")
        self.labels = handle.getMapState("labels", "i bigint", "code array<string>, y array<double>")
        self.waiting = handle.getMapState("waiting", "at bigint", "i array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            forecast = batch["q10"].notna() & batch["q90"].notna()
            for i, g in batch[forecast].groupby("i"):
                self._add(self.forecasts, int(i), g["code"], g["q10"], g["q90"], g["q10"] * np.nan, g["q90"] * np.nan)
            for i, g in batch[batch["y"].notna()].groupby("i"):
                self._add(self.labels, int(i), g["code"], g["y"])
            for at, g in batch[forecast].groupby("ts"):
                moment = int(at.timestamp() * 1000)
                held = self.waiting.getValue((moment,))[0] if self.waiting.containsKey((moment,)) else []
                self.waiting.updateValue((moment,), (sorted({*held, *(int(i) for i in g["i"])}),))
                self.handle.registerTimer(moment)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moment = expiredTimerInfo.getExpiryTimeInMs()
        days = self.waiting.getValue((moment,))[0]
        self.waiting.removeKey((moment,))
        for i in sorted(days):
            yield self._decide(key[0], int(i))

    def _add(self, state, i: int, *columns: pd.Series) -> None:
        held = state.getValue((i,)) if state.containsKey((i,)) else [[] for _ in columns]
        state.updateValue((i,), tuple([*a, *c.tolist()] for a, c in zip(held, columns)))

    def _scores(self, i: int) -> np.ndarray:
        """How far each label of a day lies outside its forecast."""
        if not (self.forecasts.containsKey((i,)) and self.labels.containsKey((i,))):
            return np.zeros(0)
        code, q10, q90, *_ = self.forecasts.getValue((i,))
        y = self._matured(i, code)
        s = np.maximum(np.asarray(q10, float) - y, y - np.asarray(q90, float))
        return s[~np.isnan(s)]

    def _matured(self, i: int, code: list[str]) -> np.ndarray:
        known = dict(zip(*self.labels.getValue((i,)))) if self.labels.containsKey((i,)) else {}
        return np.array([known.get(c, np.nan) for c in code], float)

    def _decide(self, config: str, i: int) -> pd.DataFrame:
        target = self.targets[config]
        alpha = self.level.get()[0] if self.level.exists() else target
        code, q10, q90, *_ = self.forecasts.getValue((i,))
        order = np.argsort(np.array(code, object), kind="stable")
        code, q10, q90 = [code[k] for k in order], np.asarray(q10, float)[order], np.asarray(q90, float)[order]
        newest = i + 1 - self.delay
        have = np.sort(np.concatenate([self._scores(t) for t in range(newest - self.window, newest + 1)]))
        n = len(have)
        k = int(np.ceil(round((n + 1) * (1 - alpha), 9)))
        problem = "insufficient_calibration" if n < self.least else "k_gt_n" if k > n else ""
        s = np.nan if problem else have[k - 1]
        low, high, cross = q10 - s, q90 + s, q10 > q90
        lower, upper = np.where(cross, np.fmin(low, high), low), np.where(cross, np.fmax(low, high), high)
        self.forecasts.updateValue((i,), (code, q10.tolist(), q90.tolist(), lower.tolist(), upper.tolist()))
        flags = ["+".join(x for x in (problem, "crossing" if c else "") if x) or "ok" for c in cross]
        out = pd.DataFrame({"config": config, "code": code, "i": i, "lower": lower, "upper": upper, "alpha_D": alpha, "n_calib": n, "quality_flag": flags})
        self.level.update((self._next(alpha, target, newest),))
        for state in (self.forecasts, self.labels):
            for old in [t for (t,) in state.keys() if t < newest - self.window]:
                state.removeKey((old,))
        return out

    def _next(self, alpha: float, target: float, i: int) -> float:
        """The level after the misses of the day that matured; it stays where no interval of that day has a label."""
        if not self.forecasts.containsKey((i,)):
            return alpha
        code, _, _, lower, upper = self.forecasts.getValue((i,))
        y, lower, upper = self._matured(i, code), np.asarray(lower, float), np.asarray(upper, float)
        known = ~np.isnan(y) & ~np.isnan(lower)
        if not known.any():
            return alpha
        missed = ((y < lower) | (y > upper))[known].mean()
        return float(np.clip(alpha + self.gamma * (target - missed), self.low, self.high))

    def close(self) -> None:
        pass


def adaptive(events: DataFrame, targets: dict[str, float], gamma: float, lateness: str, least: int = LEAST, window: int = WINDOW, delay: int = DELAY) -> DataFrame:
    """The intervals of :func:`paneltide.operators.conformal.adaptive` from a stream, one row for each forecast once its day is decided.

    ``events``: config, code, i, ts, q10, q90, y. A forecast has both ends and comes at the time of its decision; a label has ``y`` alone,
    the position of its forecast and the time when it matured, which is the decision time of position ``i + delay - 1``. Rows may come
    in any order and up to ``lateness`` behind the newest; a day is decided when the watermark passes it. Rows that come later than
    that are dropped by the watermark, so ``lateness`` is the bound on the source. A label without a forecast counts nowhere; of
    rows that repeat, drop the repeats before (:func:`paneltide.streaming.events.dedup`). Configurations are the parallel axis, and
    the state of one holds ``delay + window`` days. Needs the RocksDB state store (:data:`STORE`).
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    processor = Levels(targets, gamma, least, window, delay)
    return timed.groupBy("config").transformWithStateInPandas(processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")


#: Session setting that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
