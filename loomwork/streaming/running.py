"""Stateful stream operators.  Rows of a key count in the order of their order column within a batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _rows(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", na_position="first")


class _Running(StatefulProcessor):
    """State: the last average."""

    def __init__(self, key: str, order: str, value: str, alpha: float):
        self.key, self.order, self.value, self.alpha = key, order, value, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "s double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, out = _rows(rows, self.order), []
        s = self.last.get()[0] if self.last.exists() else None
        for x in pdf[self.value].astype(float):
            if not math.isnan(x):
                s = x if s is None else (1 - self.alpha) * s + self.alpha * x
            out.append(s)
        if s is not None:
            self.last.update((s,))
        yield pd.DataFrame({self.key: key[0], self.order: pdf[self.order].to_numpy(), self.value: pdf[self.value].to_numpy(), "ewma": out})

    def close(self) -> None:
        pass


def running_average(stream: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """(key, order, value, ewma) of arriving rows; equal to the batch ``ewma`` if rows arrive in order."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order, value)}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", ewma double"
    return stream.select(key, order, value).groupBy(key).transformWithStateInPandas(_Running(key, order, value, alpha), schema, "Append", "None")


class _Chunks(StatefulProcessor):
    """State: number of the chunk, and the count and squared error of its rows so far."""

    def __init__(self, key: str, order: str, x: str, xhat: str, size: int, t: float):
        self.key, self.order, self.x, self.xhat, self.size, self.t = key, order, x, xhat, size, t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "chunk long, n long, e double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, out = _rows(rows, self.order), []
        chunk, n, e = self.state.get() if self.state.exists() else (0, 0, 0.0)
        for a, b in zip(pdf[self.x].astype(float), pdf[self.xhat].astype(float)):
            n, e = n + 1, e + (a - b) ** 2
            if n == self.size:
                score = math.sqrt(e) / n
                out.append((key[0], chunk, n, score, score > self.t))
                chunk, n, e = chunk + 1, 0, 0.0
        self.state.update((chunk, n, e))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "chunk", "n", "score", "alert"])

    def close(self) -> None:
        pass


def chunk_alert(stream: DataFrame, key: str, order: str, x: str, xhat: str, size: int = 10, t: float = 0.00074) -> DataFrame:
    """(key, chunk, n, score, alert) for every ``size`` arriving rows of a key; the batch twin is ``chunk_score``."""
    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, order, x, xhat).groupBy(key).transformWithStateInPandas(_Chunks(key, order, x, xhat, size, t), f"{key} {kind}, chunk long, n long, score double, alert boolean", "Append", "None")
