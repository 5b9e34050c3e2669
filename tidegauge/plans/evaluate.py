"""Expressions over a history: the query interface."""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Dataset
from ..operators import lookback
from . import nodes as n
from . import printer
from .compiler import Compiler, filtered, lookback_ms
from .frame import Frame, on_spine
from .parser import ParseError, parse

#: How far interpolation of stepped evaluation reaches, either way.
REACH_MS = 300_000


def window(ds: Dataset, begin: datetime | None, end: datetime | None) -> Dataset:
    """The scrapes and points in [begin, end]; both are filters that reach the scan."""
    test = F.lit(True)
    if begin is not None:
        test = test & (F.col("ts") >= F.lit(begin))
    if end is not None:
        test = test & (F.col("ts") <= F.lit(end))
    return replace(ds, points=ds.points.filter(test), scrapes=ds.scrapes.filter(test))


def _begin_for(ds: Dataset, xs: list[n.Node], begin: datetime | None, reach: int) -> datetime | None:
    """The earliest instant that the look-back of ``xs`` needs."""
    if begin is None:
        return None
    ms, scrapes = max((lookback_ms(x)[0] for x in xs), default=0), max((lookback_ms(x)[1] for x in xs), default=0)
    early = begin - timedelta(milliseconds=ms + reach)
    if scrapes:
        older = ds.scrapes.select("ts").distinct().filter(F.col("ts") < F.lit(early)).orderBy(F.desc("ts")).limit(scrapes).agg(F.min("ts")).first()[0]
        early = older or early
    return early


def evaluate_frames(ds: Dataset, exprs: Mapping[str, str | n.Node], begin: datetime | None = None, end: datetime | None = None, step_ms: int = 0, interpolate: bool = False) -> dict[str, Frame]:
    """A frame for each expression, at the scrapes in [begin, end] or at every step of them.

    The scan is widened by what the expressions look back and narrowed to the
    names they read; results are cut to the range again afterwards.
    """
    xs = {k: parse(x) if isinstance(x, str) else x for k, x in exprs.items()}
    reach = REACH_MS if interpolate or step_ms else 0
    wide = filtered(window(ds, _begin_for(ds, list(xs.values()), begin, reach), end), list(xs.values()))
    if interpolate:
        wide = lookback.interpolated(wide, REACH_MS)
    inside = window(wide, begin, end).scrapes
    instants = lookback.stepped(inside, step_ms) if step_ms > 0 else inside
    out = {}
    for k, x in xs.items():
        c = Compiler(wide)
        f = on_spine(c.compile(x), c.spine)
        out[k] = replace(f, df=f.df.join(instants, "ts", "left_semi"))
    return out


def evaluate(ds: Dataset, exprs: Mapping[str, str | n.Node], begin: datetime | None = None, end: datetime | None = None, step_ms: int = 0, interpolate: bool = False) -> DataFrame:
    """ts, name, tags, tags_key, kind, b, i, d, s, h of all expressions."""
    out = None
    for name, f in evaluate_frames(ds, exprs, begin, end, step_ms, interpolate).items():
        tags = [F.col("tags"), F.col("tags_key")] if not f.scalar else [F.create_map().cast("map<string,string>").alias("tags"), F.lit("[]").alias("tags_key")]
        df = f.df.select("ts", F.lit(name).alias("name"), *tags, *f.value.columns())
        out = df if out is None else out.unionByName(df)
    return out


def as_json(result: DataFrame, names: list[str], numeric: bool = False) -> DataFrame:
    """One JSON object an instant: timestamp_msec, timestamp_str, and each name's series with tags and value.

    ``numeric`` keeps numbers only. Rows come in order of time.
    """
    number = F.coalesce("d", F.col("i").cast("double"), F.col("b").cast("double"))
    rows = result.filter(number.isNotNull()) if numeric else result
    text = F.coalesce("s", F.col("i").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"))
    one = F.struct("tags", text.alias("value"), F.concat("name", "tags_key").alias("name_tags"))
    per = rows.groupBy("ts").agg(*[F.sort_array(F.collect_list(F.when(F.col("name") == k, F.to_json(one)))).alias(k) for k in names])
    quoted = lambda k: F.lit(json.dumps(k))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    metrics = F.concat_ws(",", *[F.concat(quoted(k), F.lit(":["), F.array_join(k, ","), F.lit("]")) for k in names])
    text = F.concat(F.lit('{"timestamp_msec":'), F.unix_millis("ts").cast("string"), F.lit(',"timestamp_str":"'), stamp, F.lit('","metrics":{'), metrics, F.lit("}}"))
    return per.select("ts", text.alias("json")).orderBy("ts")


def pages(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in pages, fetched partition by partition."""
    page = []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        page.append(r)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


@dataclass(frozen=True)
class Portion:
    """``cookie`` is what the next portion is asked with; None after the last."""

    rows: list
    cookie: str | None


class Portions:
    """Rows of a result in portions that end at ``size`` rows or after ``delay_s``, whichever comes first.

    Rows are fetched meanwhile, partition by partition, at most ``ahead`` of
    what was asked for. A cookie is good for one portion: with any other than
    the last one given LookupError is raised, and one begins anew, from the
    instant after the last row seen.
    """

    def __init__(self, rows: DataFrame, ahead: int = 10_000):
        self._held: queue.Queue = queue.Queue(ahead)
        self._cookie, self._closed = None, threading.Event()
        threading.Thread(target=self._fetch, args=(rows,), daemon=True).start()

    def _put(self, what: tuple) -> bool:
        while not self._closed.is_set():
            try:
                self._held.put(what, timeout=0.2)
                return True
            except queue.Full:
                pass
        return False

    def _fetch(self, rows: DataFrame) -> None:
        try:
            for r in rows.toLocalIterator(prefetchPartitions=True):
                if not self._put(("row", r)):
                    return
            self._put(("end", None))
        except Exception as e:  # raised to whoever asks next
            self._put(("error", e))

    def next(self, size: int, delay_s: float | None = None, cookie: str | None = None) -> Portion:
        if cookie != self._cookie or self._closed.is_set():
            raise LookupError("this cookie was used before, or its result is closed")
        until, got = None if delay_s is None else time.monotonic() + delay_s, []
        self._cookie = uuid.uuid4().hex
        while len(got) < size:
            try:
                kind, x = self._held.get(timeout=None if until is None else max(0.0, until - time.monotonic()))
            except queue.Empty:
                break
            if kind == "row":
                got.append(x)
                continue
            self.close()
            if kind == "error":
                raise x
            return Portion(got, None)
        return Portion(got, self._cookie)

    def close(self) -> None:
        self._closed.set()


@dataclass(frozen=True)
class Validation:
    ok: bool
    parse_errors: tuple[str, ...] = ()
    normalized_query: str | None = None


def validate(text: str) -> Validation:
    """Whether an expression parses; its canonical text, or what is wrong with it."""
    try:
        return Validation(True, (), printer.expression(parse(text)))
    except ParseError as e:
        return Validation(False, (str(e),))
