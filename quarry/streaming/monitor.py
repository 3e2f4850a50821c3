"""Metrics watched in keyed state: histories, thresholds, alerts that come once, and silence found by timers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERTS = "metric string, kind string, at timestamp, value double, mean double"


@dataclass(frozen=True)
class Rule:
    """When a metric breaks: a value above most or below least, so many times in a row.

    silent: seconds of event time without a value after which the metric is
    reported; None for never.
    """

    most: float | None = None
    least: float | None = None
    in_a_row: int = 1
    silent: int | None = None

    def broken(self, value: float) -> bool:
        return (self.most is not None and value > self.most) or (self.least is not None and value < self.least)


class Watch(StatefulProcessor):
    """State of a metric: its last values, how many broke its rule in a row, whether an alert is out.

    All of it is bounded by history, and goes with its timer once a metric has
    been silent.
    """

    def __init__(self, rules: dict[str, Rule], default: Rule, history: int):
        self.rules, self.default, self.history = rules, default, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "values array<double>, streak int, alerted boolean, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rule = self.rules.get(key[0], self.default)
        values, streak, alerted, last = self.state.get() if self.state.exists() else ([], 0, False, 0.0)
        values, out = list(values), []
        seen = pd.concat(list(rows)).dropna(subset=["at", "value"]).sort_values(["at", "value"], kind="stable")
        for at, value in zip(seen["at"], seen["value"].astype(float)):
            values = [*values, value][-self.history :]
            streak = streak + 1 if rule.broken(value) else 0
            kind = "breach" if streak >= rule.in_a_row and not alerted else "cleared" if alerted and not streak else None
            if kind:
                alerted = kind == "breach"
                out.append((key[0], kind, at, value, sum(values) / len(values)))
            last = max(last, at.timestamp())
        self.state.update((values, streak, alerted, last))
        if rule.silent is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((last + rule.silent) * 1000))
        yield pd.DataFrame(out, columns=["metric", "kind", "at", "value", "mean"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        values, _, _, last = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], "silent", pd.Timestamp(last, unit="s"), values[-1] if values else None, sum(values) / len(values) if values else None)], columns=["metric", "kind", "at", "value", "mean"])

    def close(self) -> None:
        pass


def alerts(metrics: DataFrame, rules: dict[str, Rule], default: Rule = Rule(), history: int = 100, late: str = "10 minutes") -> DataFrame:
    """metric, kind, at, value, mean: what is to be told of a stream of metrics (metric, at, value).

    breach once a rule has been broken often enough in a row, cleared with the
    first value after it that keeps the rule, silent when the watermark has passed
    a metric's last value by the rule's seconds; its state is gone then. mean is
    of the last `history` values. Within a batch the values of a metric count in
    order of time; rows without a time or a value are left out. The session's
    state store must be RocksDB.
    """
    watched = metrics.select("metric", "at", "value").withWatermark("at", late)
    return watched.groupBy("metric").transformWithStateInPandas(Watch(rules, default, history), ALERTS, "append", "eventTime")


def channels(found: DataFrame, severe: set[str]) -> DataFrame:
    """Alerts with a channel each: page for a breach or silence of a severe metric, mail for another one's, log for the rest."""
    bad = F.col("kind").isin("breach", "silent")
    return found.withColumn("channel", F.when(bad & F.col("metric").isin(*severe), "page").when(bad, "mail").otherwise("log"))
