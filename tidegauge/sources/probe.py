"""HTTP and TCP probes of targets, run by Spark tasks under a deadline.

A probe never fails its task: what went wrong becomes metrics of the target.
Results can also be landed as JSON and read back, which is how the points are
made either way.
"""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import points, value
from ..storage import cut
from .json_flat import flatten

# The deadline of a scrape, in seconds; probes at once in a task.
DEADLINE_S, AT_ONCE = 29.0, 64
TCP_ERRORS = ("timed_out", "no_route_to_host", "port_unreachable", "unknown_host", "unknown_service", "connect_failed", "protocol_error", "bind_failed", "io_error")


def probe_url(url: str, timeout: float = DEADLINE_S, body: bool = False) -> dict:
    """What a GET of ``url`` finds, as nested metrics; only ``up`` = false if it fails."""
    begun = time.monotonic()
    try:
        try:
            answer = urllib.request.urlopen(url, timeout=timeout)
        except urllib.error.HTTPError as e:  # an answer, too
            answer = e
        with answer:
            text = answer.read()
            headers = answer.headers
            out = {
                "up": True,
                "latency": int((time.monotonic() - begun) * 1000),
                "status": {"code": answer.status, "line": f"HTTP/{answer.version // 10}.{answer.version % 10} {answer.status} {answer.reason}" if hasattr(answer, "version") else str(answer.status)},
                "protocol": {"name": "HTTP", "major": getattr(answer, "version", 11) // 10, "minor": getattr(answer, "version", 11) % 10},
                "content": {"chunked": headers.get("Transfer-Encoding", "") == "chunked", "length": len(text), "type": headers.get("Content-Type"), "charset": headers.get_content_charset(), "mimetype": headers.get_content_type()},
                "locale": {"language": headers.get("Content-Language")},
                "header": {k: _number(v) for k, v in headers.items()},
            }
            if body:
                try:
                    out["body"] = json.loads(text)
                except ValueError:
                    pass
            return out
    except (OSError, ValueError):
        return {"up": False}


def _number(x: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def probe_tcp(address: str, timeout: float = DEADLINE_S) -> dict:
    """What connecting to ``host:port`` finds: up and latency, or which error; every kind of error is a boolean."""
    host, _, port = address.rpartition(":")
    begun, kind, text = time.monotonic(), None, None
    try:
        socket.create_connection((host, int(port)), timeout).close()
    except TimeoutError as e:
        kind, text = "timed_out", str(e)
    except socket.gaierror as e:
        kind, text = "unknown_host", str(e)
    except ConnectionRefusedError as e:
        kind, text = "connect_failed", str(e)
    except ValueError as e:
        kind, text = "unknown_service", str(e)
    except OSError as e:
        kind, text = {113: "no_route_to_host", 99: "bind_failed"}.get(e.errno, "io_error"), str(e)
    out = {"up": kind is None, "error": {"type": (kind or "ok").upper(), "msg": text, **{k: k == kind for k in TCP_ERRORS}}}
    return out | ({"latency": int((time.monotonic() - begun) * 1000)} if kind is None else {})


def collect(targets: DataFrame, probe: Callable[[str], dict], tasks: int = 8, deadline_s: float = DEADLINE_S) -> DataFrame:
    """ts, group_path, tags, json of each of ``targets`` (target, group_path, tags), probed in parallel.

    A task waits for ``deadline_s`` from its start. Targets that aren't done by
    then, or whose probe raises, have null results: they make no points, but
    ``failed`` counts them, and what others found is kept. Targets are probed
    at once, and results are checkpointed, so that no use of them probes again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        until, pool = time.monotonic() + deadline_s, ThreadPoolExecutor(AT_ONCE)
        try:
            for b in batches:
                asked = [pool.submit(lambda t: json.dumps(probe(t)), t) for t in b["target"]]
                wait(asked, max(0.0, until - time.monotonic()))
                texts = [f.result() if f.done() and not f.cancelled() and f.exception() is None else None for f in asked]
                yield pd.DataFrame({"target": b["target"], "json": pd.Series(texts, dtype=object)})
        finally:
            pool.shutdown(wait=False, cancel_futures=True)  # what hangs ends by its own timeout

    found = targets.select("target").distinct().repartition(tasks).mapInPandas(run, "target string, json string")
    return cut(targets.join(found, "target").select(F.current_timestamp().alias("ts"), "group_path", "tags", "json"))


def to_points(results: DataFrame) -> DataFrame:
    """Points of probe results (ts, group_path, tags, json), their nesting as dotted metric names."""
    flat = flatten(results, "json", ())
    v = value(bool=F.col("b"), int=F.col("i"), dbl=F.col("d"), string=F.col("s"))
    return points(flat, F.col("group_path"), F.col("metric"), v, F.col("tags"))


def failed(results: DataFrame) -> Column:
    """How many targets weren't up or have no result, as an aggregate."""
    return F.sum((~F.coalesce(F.get_json_object("json", "$.up").cast("boolean"), F.lit(False))).cast("bigint"))


# --- JMX dumps ---------------------------------------------------------------


def mbean_points(dumps: DataFrame, base: tuple[str, ...] = ()) -> DataFrame:
    """Points of dumped MBeans (ts, object: ``domain:key=value,…``, attributes: JSON).

    The group is the dotted ``name``, else the domain and ``type``, else the
    domain; other keys are tags, typed by how they look. Nested attributes are
    flattened; arrays and nulls are dropped.
    """
    domain = F.substring_index("object", ":", 1)
    pairs = F.transform(F.split(F.substring(F.col("object"), F.instr("object", ":") + 1, F.length("object")), ","), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value")))
    df = dumps.withColumn("keys", F.map_from_entries(pairs))
    name, kind = F.try_element_at("keys", F.lit("name")), F.try_element_at("keys", F.lit("type"))
    path = F.when(name.isNotNull(), F.split(name, r"\.")).when(kind.isNotNull(), F.concat(F.split(domain, r"\."), F.array(kind))).otherwise(F.split(domain, r"\."))
    prefix = F.array(*[F.lit(b) for b in base]).cast("array<string>")

    def typed(x: Column) -> Column:
        return F.when(x.isin("true", "false"), F.concat(F.lit("b:"), x)).when(x.rlike(r"^[+-]?[0-9]{1,18}$"), F.concat(F.lit("i:"), x.try_cast("bigint").cast("string"))).when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.concat(F.lit("d:"), x.try_cast("double").cast("string"))).otherwise(F.concat(F.lit("s:"), x))

    tags = F.transform_values(F.map_filter("keys", lambda k, v: ~k.isin("name", "type")), lambda k, v: typed(v))
    df = df.withColumn("group", F.concat(prefix, path)).withColumn("tags", tags)
    flat = flatten(df.select("ts", "group", "tags", "attributes"), "attributes", ()).filter("kind <> 'empty'")
    indexed = F.exists("metric", lambda m: m.rlike("^[0-9]+$"))
    v = value(bool=F.col("b"), int=F.col("i"), dbl=F.col("d"), string=F.col("s"))
    return points(flat.filter(~indexed), F.col("group"), F.col("metric"), v, F.col("tags"))


