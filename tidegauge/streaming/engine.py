"""The scrape loop as a stream: rules over each micro-batch, alerts carried as keyed state.

``run`` feeds each micro-batch of new points, together with as much history as
the rules look back, through the same rules as a batch does, appends the new
scrapes to the history and hands results to processors. ``alert_stream``
carries alert states by key in the state store, for streams whose predicates
need no look-back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import Dataset
from ..operators.rules import Outcome, apply_rules
from ..plans import nodes as n
from ..plans.compiler import lookback_ms
from ..sources.history import History

#: A processor gets the new points after the rules, the new alerts, and how many collections failed.
Processor = Callable[[DataFrame, "DataFrame | None", int], None]


def rule_expressions(rules: Iterable[n.Node]) -> Iterator[n.Node]:
    """All expressions of rules, in matches too."""
    for r in rules:
        if isinstance(r, n.MatchRule):
            yield from [r.where] if r.where else []
            yield from rule_expressions(r.rules)
        elif isinstance(r, n.Define):
            yield from (x for _, x in (*r.metrics, *r.tags))
        elif isinstance(r, n.SetTag):
            yield from (x for _, x in r.tags)
        elif isinstance(r, n.Alert):
            yield r.when
            for _, x in r.attributes:
                yield from x if isinstance(x, tuple) else (x,)


def retention(rules: tuple[n.Node, ...]) -> tuple[int, int]:
    """The union of what rules look back: milliseconds, and scrapes; alert durations count, at least one scrape stays."""
    found = [lookback_ms(x) for x in rule_expressions(rules)]

    def longest(rs: Iterable[n.Node]) -> int:
        return max((longest(r.rules) if isinstance(r, n.MatchRule) else r.for_ms if isinstance(r, n.Alert) else 0 for r in rs), default=0)

    return max((f[0] for f in found), default=0) + longest(rules), max(1, *(f[1] + 1 for f in found)) if found else 1


def step(new: Dataset, history: History | None, rules: tuple[n.Node, ...], warm: bool = True) -> Outcome:
    """Rules over new scrapes with the history they look back to; the result holds the new scrapes only."""
    instants = new.scrapes.select("ts").distinct()
    ds = new
    if history is not None and warm and history.exists:
        ms, count = retention(rules)
        first = instants.agg(F.min("ts")).first()[0]
        if first is None:
            return Outcome(new)
        early = history.newest(count, first)
        begin = min([first - timedelta(milliseconds=ms), *early])
        old = history.scan(begin, first - timedelta(milliseconds=1))
        earliest = old.scrapes.agg(F.min("ts")).first()[0]
        ds = Dataset(old.points.unionByName(new.points), old.scrapes.unionByName(new.scrapes), new.kinds)
    out = apply_rules(ds, rules)
    if ds is not new and out.alerts is not None and history.has_alerts:
        out = Outcome(out.dataset, _carried(out.alerts, history.alerts(earliest), earliest))
    points = out.dataset.points.join(instants, "ts", "left_semi")
    alerts = out.alerts.join(instants, "ts", "left_semi") if out.alerts is not None else None
    return Outcome(Dataset(points, instants, out.dataset.kinds), alerts)


def _carried(alerts: DataFrame, known: DataFrame, earliest) -> DataFrame:
    """Alerts that were going on at the first scrape of a window began when that scrape's alerts say; ``known`` has those."""
    then = known.select("alert_key", "tags_key", F.col("start").alias("began"))
    rows = alerts.join(then, ["alert_key", "tags_key"], "left")
    rows = rows.withColumn("start", F.when(F.col("start") == F.lit(earliest), F.coalesce("began", "start")).otherwise(F.col("start"))).drop("began")
    lasted = F.unix_millis("ts") - F.unix_millis("start")
    return rows.withColumn("state", F.when(F.col("triggered"), F.when(lasted >= F.col("for_ms"), "FIRING").otherwise("TRIGGERING")).otherwise(F.col("state")))


def run(points: DataFrame, rules: tuple[n.Node, ...], processors: list[Processor], checkpoint: str, history: History | None = None, interval: str | None = "60 seconds") -> StreamingQuery:
    """A streaming query over new points; without ``interval`` it takes what there is and ends."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            out = step(Dataset(df, df.select("ts").distinct()), history, rules)
            if history is not None:
                history.append(out.dataset, number)
                if out.alerts is not None:
                    history.append_alerts(out.alerts)
            for p in processors:
                p(out.dataset.points, out.alerts, 0)
        finally:
            df.unpersist()

    writer = points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


ALERTS = "ts timestamp, alert_key string, tags_key string, triggered boolean, state string, start timestamp"


class AlertState(StatefulProcessor):
    """One alert: since when it says what it says, and the place of the scrape that said so last.

    Rows of a key come with the place of their scrape (``place`` long), which
    counts up by one a scrape; a place left out ends what went before.
    """

    def __init__(self, for_ms: int):
        self.for_ms = for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "place long, says boolean, start timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values("place")
        held = self.held.get() if self.held.exists() else None
        out = []
        for r in df.itertuples():
            triggered = None if pd.isna(r.triggered) else bool(r.triggered)
            says = triggered is not False
            start = pd.Timestamp(held[2]) if held is not None and held[0] == r.place - 1 and held[1] == says else r.ts
            held = (int(r.place), says, start.to_pydatetime())
            lasted = (r.ts - start).total_seconds() * 1000
            state = "UNKNOWN" if triggered is None else "OK" if not triggered else "FIRING" if lasted >= self.for_ms else "TRIGGERING"
            out.append((r.ts, key[0], key[1], triggered, state, start))
        if held is not None:
            self.held.update(held)
        yield pd.DataFrame(out, columns=["ts", "alert_key", "tags_key", "triggered", "state", "start"])

    def close(self) -> None:
        pass


def alert_stream(rows: DataFrame, for_ms: int) -> DataFrame:
    """States of a stream of (ts, place, alert_key, tags_key, triggered), from keyed state."""
    return rows.groupBy("alert_key", "tags_key").transformWithStateInPandas(AlertState(for_ms), ALERTS, "append", "none")
