from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


BEGIN = dt.datetime(2024, 1, 1)


def instant(i: int, seconds: int = 60) -> dt.datetime:
    return BEGIN + dt.timedelta(seconds=i * seconds)


def replay(spark, series, scrapes=None, seconds=60):
    """A dataset from (group, tags, metric, values a scrape); None is no point, ``EMPTY`` an empty value."""
    from tidegauge.model import POINTS, Dataset, path_key, tag_literal

    rows = []
    n = scrapes or max(len(v) for *_, v in series)
    for group, tags, metric, values in series:
        typed = {k: tag_literal(v) for k, v in tags.items()}
        key = "[" + ",".join(f'{{"key":"{k}","value":"{v}"}}' for k, v in sorted(typed.items())) + "]"
        for i, x in enumerate(values):
            if x is None:
                continue
            v = dict.fromkeys("bidsh")
            kind = "empty" if x is EMPTY else "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "dbl" if isinstance(x, float) else "string" if isinstance(x, str) else "hist"
            if kind != "empty":
                v[{"bool": "b", "int": "i", "dbl": "d", "string": "s", "hist": "h"}[kind]] = x
            gp, mp = group.split("."), metric.split(".")
            rows.append((instant(i, seconds), path_key(gp), gp, typed, key, path_key(mp), mp, kind, v["b"], v["i"], v["d"], v["s"], v["h"]))
    points = spark.createDataFrame(rows, POINTS)
    return Dataset(points, spark.createDataFrame([(instant(i, seconds),) for i in range(n)], "ts timestamp"))


EMPTY = object()
