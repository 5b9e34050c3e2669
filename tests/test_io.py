"""Sources, sinks, history, streaming and configurations."""

import datetime as dt
import json
import re
import socket
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from conftest import EMPTY, instant, replay
from pyspark.sql import functions as F

from tidegauge import __main__ as cli
from tidegauge.model import Dataset
from tidegauge.operators.rules import apply_rules
from tidegauge.plans import config
from tidegauge.plans.evaluate import Portions, as_json, evaluate, pages
from tidegauge.plans.parser import parse_configuration, parse_rules
from tidegauge.sinks import lines
from tidegauge.sources import collectd, influx_json, json_flat, monitor, probe, resolver
from tidegauge.sources.history import History, convert, last_wins
from tidegauge.streaming import engine


def texts(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture
def sample(spark):
    h = [(0.0, 1.0, 2.0), (1.0, 3.0, 4.0)]
    return replay(spark, [("Some.group-x", {"host": 'a"b', "n": 1}, "m.x", [1, 2.5, True]), ("Some.group-x", {"host": 'a"b', "n": 1}, "t", ["text", EMPTY, float("nan")]), ("H", {}, "h", [h, None, None])])


def test_wavefront(sample):
    got = texts(lines.wavefront(sample.points, "here"))
    assert got == [
        r'some.group-x.m.x 1 1704067200 source=here host="a\"b" n="1"',
        r'some.group-x.m.x 1 1704067320 source=here host="a\"b" n="1"',
        r'some.group-x.m.x 2.5 1704067260 source=here host="a\"b" n="1"',
    ]


def test_wavefront_source_and_length(spark):
    ds = replay(spark, [("g", {"source": "s", "k" * 200: "v" * 200}, "m", [1])])
    (line,) = texts(lines.wavefront(ds.points))
    assert line == "g.m 1 1704067200 source=s " + "k" * 127 + '="' + "v" * 125 + '"'


def test_prometheus(sample):
    assert texts(lines.prometheus(sample.points)) == [f'some_groupx_mx{{host="a\\"b",n="1"}} {x}'.replace("_mx", "_m_x") for x in ("1", "1", "2.5")] + ['some_groupx_t{host="a\\"b",n="1"} NaN']


def test_json_and_listing(sample):
    rows = [json.loads(r.json) for r in lines.json_scrapes(sample.points).orderBy("ts").collect()]
    assert rows[0]["ts_msec"] == 1704067200000 and rows[0]["ts"] == "2024-01-01T00:00:00.000Z"
    group = next(v for k, v in rows[0]["data"].items() if k.startswith("Some"))
    assert group == {"m.x": 1, "t": "text"} and rows[0]["data"]["H"]["h"] == {"0.0..1.0": 2.0, "1.0..3.0": 4.0}
    assert rows[1]["data"]["Some.'group-x'{host=\"a\"b\", n=1}"]["t"] is None
    assert [r.line.split(" ")[-3:] for r in lines.listing(sample.points).collect()] == [["m.x", "=", "true"], ["t", "=", '"NaN"']]


def test_influx_lines(sample):
    got = texts(lines.influx(sample.points))
    assert "H,__range__=0.0..1.0 h=2.0 1704067200000000000" in got and 'Some.group-x,host=a"b,n=1 t="text" 1704067200000000000' in got
    assert len(got) == 6


def test_influx_results(spark, tmp_path):
    series = lambda r, n: {"name": "a.b", "tags": {"host": "x", "empty": "", "__range__": r}, "columns": ["time", "h.q"], "values": [[1000, n]]}
    plain = {"name": "a.b", "columns": ["time", "v", "s", "z"], "values": [[1000, 1, "17x", None], [2000, 2.5, "true", True]]}
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"series": [series("0.0..1.0", 3), series("1.0..2.0", 5.0), plain]}]}))
    got = {(r.ts.second, r.metric_key): r for r in influx_json.read(spark, str(tmp_path / "r.json")).collect()}
    assert [tuple(x) for x in got[1, "h.q"].h] == [(0.0, 1.0, 3.0), (1.0, 2.0, 5.0)] and got[1, "h.q"].tags == {"host": "s:x"}
    assert got[1, "v"].i == 1 and got[2, "v"].d == 2.5 and got[1, "s"].s == "17x" and got[2, "z"].b is True and (1, "z") not in got


def test_influx_server(spark):
    """Slices of an hour cover a range exactly once; histograms and their instants stay whole; errors are raised."""
    at = [instant(0).replace(tzinfo=dt.UTC) + dt.timedelta(minutes=m) for m in range(0, 300, 7)]
    stamps, asked = [int(t.timestamp() * 1000) for t in at], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            args = parse_qs(urlparse(self.path).query)
            asked.append(args["q"][0])
            low, high = map(int, re.findall(r"(\d+)ms", args["q"][0]))
            there = [t for t in stamps if low <= t <= high]
            series = [{"name": "a.b", "columns": ["time", "v"], "values": [[t, t % 1000 + 0.5] for t in there]}]
            series += [{"name": "a.b", "tags": {"__range__": r}, "columns": ["time", "h"], "values": [[t, n] for t in there]} for r, n in (("0.0..1.0", 3), ("1.0..2.0", 5))]
            out = {"results": [{"error": "no such"}]} if args["db"] == ["none"] else {"results": [{"series": series} if there else {}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    begin, end = at[3], at[-2]
    got = influx_json.scan(spark, url, "db", begin, end, influx_json.select(("a", "b"))).collect()
    assert sorted(int(r.ts.replace(tzinfo=dt.UTC).timestamp() * 1000) for r in got if r.metric_key == "v") == stamps[3:-1]
    assert sorted(len(r.h) for r in got if r.metric_key == "h") == [2] * len(stamps[3:-1])
    assert len(set(asked)) == len(asked) == 5 and all('FROM "a.b" WHERE' in q for q in asked)
    assert influx_json.scan(spark, url, "db", end, begin).count() == 0
    with pytest.raises(ValueError, match="no such"):
        influx_json.ask(url, "none", "SELECT * FROM x WHERE time >= 0ms AND time <= 1ms")
    server.shutdown()


def test_pushdown_rendering():
    from tidegauge.plans.parser import Parser

    pattern = lambda t: Parser(t).path_pattern()
    assert influx_json.select(pattern("foo.bar")) == '"foo.bar"'
    assert influx_json.select(pattern("wildcard.*")) == r"/^wildcard\..*$/"
    assert influx_json.select(pattern("regex.//a+//")) == r"/^regex\..*a+.*$/"
    assert influx_json.select(pattern("//^a+$//")) == "/^.*$/"


def test_json_flattening(spark):
    text = json.dumps({"a": {"b": [1, 2.5, "x]{", {"c": None}]}, "t": True, "e": {}, "big": 12345678901234567890, "q": 'a"\\'})
    rows = spark.createDataFrame([(1, text), (2, "not json"), (3, None), (4, "7")], "id long, j string")
    got = {(r.id, ".".join(r.metric)): (r.kind, r.b, r.i, r.d, r.s) for r in json_flat.flatten(rows, "j").collect()}
    assert got[1, "body.a.b.0"] == ("int", None, 1, None, None) and got[1, "body.a.b.1"][3] == 2.5 and got[1, "body.a.b.2"][4] == "x]{"
    assert got[1, "body.a.b.3.c"][0] == "empty" and got[1, "body.t"][1] is True and got[1, "body.q"][4] == 'a"\\'
    assert got[1, "body.big"][0] == "dbl" and got[4, "body"][2] == 7 and len(got) == 8
    stated = json_flat.flatten(rows, "j", levels=6)
    assert {(r.id, ".".join(r.metric)): (r.kind, r.b, r.i, r.d, r.s) for r in stated.collect()} == got
    assert "Union" not in stated._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="nests deeper than 2 levels"):
        json_flat.flatten(rows, "j", levels=2).collect()


def message(**x):
    return {"values": [1], "dstypes": ["gauge"], "dsnames": ["value"], "time": 1704067200.0, "interval": 10, "host": "h1", "plugin": "cpu", "plugin_instance": "", "type": "cpu", "type_instance": "idle"} | x


def test_collectd(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([message(), message(values=[1.5, 2], dsnames=["rx", "tx"], plugin="if", plugin_instance='eth0[dc=lhr,rack=7,q="a,b"]', type="octets", type_instance=""), message(type="", type_instance="", plugin="odd")]))
    got = {(r.group_key, r.metric_key): r for r in collectd.to_points(collectd.read(spark, str(tmp_path)), ("base",)).collect()}
    assert got["base.cpu", "cpu.idle"].i == 1 and got["base.cpu", "cpu.idle"].tags == {"host": "s:h1"}
    assert got["base.'if'", "octets.rx"].d == 1.5 if ("base.'if'", "octets.rx") in got else got["base.if.eth0", "octets.rx"].d == 1.5
    assert got["base.if.eth0", "octets.tx"].tags == {"host": "s:h1", "dc": "s:lhr", "rack": "i:7", "q": "s:a,b"}
    assert got["base.odd", "value"].i == 1


def test_collectd_hosts(spark):
    scrapes = spark.createDataFrame([(instant(i, 1200),) for i in range(6)], "ts timestamp")
    seen = spark.createDataFrame([(instant(0), "a"), (instant(1, 1200), "b"), (instant(5, 1200), "a")], "ts timestamp, host string")
    got = {(r.ts.hour * 60 + r.ts.minute, r.tags["host"]): r.b for r in collectd.host_states(seen, scrapes).collect()}
    assert got == {(0, "s:a"): True, (20, "s:a"): False, (40, "s:a"): False, (20, "s:b"): True, (40, "s:b"): False, (60, "s:b"): False, (100, "s:a"): True}


def test_resolver(spark):
    c = parse_configuration('collect url "http://$0.x:${port}/" as a.b { 0 = ["p", "q"], (port, up) = [(80, true), (81, false)] }').collects[0]
    rows = resolver.targets(spark, c).collect()
    assert {r.target for r in rows} == {f"http://{h}.x:{p}/" for h in "pq" for p in (80, 81)}
    assert {(tuple(r.group_path), tuple(sorted(r.tags.items()))) for r in rows} >= {(("a", "b", "p"), (("port", "i:80"), ("up", "b:true")))}
    with pytest.raises(KeyError):
        resolver.expand("http://$1", {0: "x"})
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "target string")
    assert {tuple(r) for r in resolver.changes(t("a", "b"), t("b", "c")).collect()} == {("c", "created"), ("a", "closed")}


def test_probes(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/" else 404)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("X-N", "17")
            self.end_headers()
            self.wfile.write(b'{"k": [1, {"z": null}]}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_port
    free = socket.socket()
    free.bind(("127.0.0.1", 0))
    gone = free.getsockname()[1]
    free.close()
    schema = "target string, group_path array<string>, tags map<string,string>"
    urls = spark.createDataFrame([(f"http://127.0.0.1:{port}/", ["u"], {"a": "s:1"}), (f"http://127.0.0.1:{gone}/", ["v"], {})], schema)
    found = probe.collect(urls, lambda u: probe.probe_url(u, 5, body=True), 2)
    got = {(r.group_key, r.metric_key): r for r in probe.to_points(found).collect()}
    assert got["u", "up"].b and got["u", "status.code"].i == 200 and got["u", "body.k.'0'"].i == 1 and got["u", "body.k.'1'.z"].kind == "empty"
    assert got["u", "header.'X-N'"].i == 17 and got["u", "content.mimetype"].s == "application/json" and got["u", "up"].tags == {"a": "s:1"}
    assert got["v", "up"].b is False and sum(k[0] == "v" for k in got) == 1
    assert found.agg(probe.failed(found)).first()[0] == 1
    tcp = [probe.probe_tcp(f"127.0.0.1:{port}", 5), probe.probe_tcp(f"127.0.0.1:{gone}", 5), probe.probe_tcp("127.0.0.1:x", 5)]
    assert tcp[0]["up"] and "latency" in tcp[0] and tcp[1]["error"]["connect_failed"] and tcp[2]["error"]["unknown_service"]
    server.shutdown()


def test_scrape_deadline(spark):
    """What is late or raises counts as failed; the others' results are there in time."""

    def slow(target):
        if target == "late":
            time.sleep(8)
        if target == "wrong":
            raise RuntimeError("probe")
        return {"up": target != "down", "n": 1}

    names = ["a", "late", "wrong", "down", "b"]
    targets = spark.createDataFrame([(t, [t], {}) for t in names], "target string, group_path array<string>, tags map<string,string>")
    begun = time.monotonic()
    found = probe.collect(targets, slow, 1, deadline_s=1.0)
    assert time.monotonic() - begun < 7
    assert {r.group_key for r in probe.to_points(found).collect()} == {"a", "b", "down"}
    assert found.agg(probe.failed(found)).first()[0] == 3 and found.count() == 5


def test_mbeans(spark):
    rows = spark.createDataFrame([(instant(0), "java.lang:type=Memory", '{"Heap": {"used": 5, "max": 9}, "Verbose": false, "L": [1], "N": null}'), (instant(0), "x:name=a.b,type=T,port=80,d=1.5,f=true,s=q", '{"V": "t"}')], "ts timestamp, object string, attributes string")
    got = {(r.group_key, r.metric_key): r for r in probe.mbean_points(rows).collect()}
    assert set(got) == {("java.lang.Memory", "Heap.used"), ("java.lang.Memory", "Heap.max"), ("java.lang.Memory", "Verbose"), ("a.b", "V")}
    assert got["a.b", "V"].tags == {"port": "i:80", "d": "d:1.5", "f": "b:true", "s": "s:q"}


def series(spark, n=6):
    return replay(spark, [("A", {"h": 1}, "x", list(range(n))), ("B", {}, "y", [float(i) for i in range(n)])], seconds=6 * 3600)


@pytest.mark.parametrize("compression", ["none", "gzip", "snappy", "zstd"])
def test_history_round_trip(spark, tmp_path, compression):
    ds = series(spark)
    h = History(spark, str(tmp_path / "h"), compression)
    h.append(ds)
    key = lambda df: sorted((r.ts, r.group_key, r.tags_key, r.metric_key, r.i, r.d) for r in df.collect())
    assert key(h.scan().points) == key(ds.points)
    assert key(h.scan(instant(1, 21600), instant(2, 21600)).points) == key(ds.points.filter(F.col("ts").between(instant(1, 21600), instant(2, 21600))))
    assert not h.overlaps
    h.append(Dataset(ds.points.filter("ts = timestamp'2024-01-01'").withColumn("i", F.lit(99).cast("bigint")), ds.scrapes.limit(1)), batch=1)
    assert key(h.scan().points) == key(ds.points)
    assert h.overlaps
    h.compact()
    assert not h.overlaps
    assert key(h.scan().points) == key(ds.points) and h.catalog().count() == 2 and h.scan().scrapes.count() == 6
    assert [r.ts for r in h.reversed().collect()] == sorted([r.ts for r in ds.points.collect()], reverse=True)
    assert [r.i for r in h.group("A", '[{"key":"h","value":"i:1"}]', instant(3, 21600)).collect()] == [3, 4, 5]
    assert h.stepped(12 * 3_600_000).scrapes.count() == 3
    convert(h, History(spark, str(tmp_path / "copy")))
    assert key(History(spark, str(tmp_path / "copy")).scan().points) == key(ds.points)
    assert h.retain(1) == ["2024-01-01"] and h.scan().scrapes.count() == 2


@pytest.mark.parametrize("calls", range(6))
def test_compaction_broken_off(spark, tmp_path, monkeypatch, calls):
    """Wherever a swap ends, the next reader finds every point."""
    ds, h = series(spark), History(spark, str(tmp_path / "h"))
    h.append(ds)
    done, real = [], h._fs

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            def call(*args):
                if name in ("delete", "rename"):
                    if len(done) == calls:
                        raise OSError("lost")
                    done.append(name)
                return getattr(self.fs, name)(*args)

            return call

    monkeypatch.setattr(h, "_fs", lambda path: (Broken(real(path)[0]), real(path)[1]))
    try:
        h.compact()
    except OSError:
        assert len(done) == calls
    again = History(spark, h.path)
    assert again.scan().points.count() == 12 and again.scan().scrapes.count() == 6 and not again.overlaps
    assert not [p.name for p in (tmp_path / "h").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_newest_reads_back_in_time(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.newest() == []
    h.append(series(spark, 10))
    assert h.newest() == [instant(9, 21600)] and h.newest(4, instant(6, 21600)) == [instant(i, 21600) for i in (5, 4, 3, 2)]
    assert len(h.newest(99)) == 10 and h.newest(2, instant(0)) == []


def test_cached_resolver():
    from tidegauge.sources.resolver import Cached, numbers

    assert numbers(3) == ((0,), (1,), (2,)) and numbers(5, 3) == ((3,), (4,)) and numbers(0) == ()
    now, answers = [0.0], [((1,),), ((2,),), OSError("down"), OSError("down"), ((3,),)]

    def resolve():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    c = Cached(resolve, 10, 30, 5, lambda: now[0])
    seen = []
    for t in (0, 9, 10, 19, 20, 24, 39, 40, 41, 46):
        now[0] = float(t)
        try:
            seen.append(c())
        except OSError:
            seen.append(None)
    one, two, three = ((1,),), ((2,),), ((3,),)
    assert seen == [one, one, two, two, two, two, two, None, None, three]


def test_last_collected_wins(spark):
    ds = series(spark, 1)
    twice = ds.points.withColumn("batch", F.lit(1)).unionByName(ds.points.withColumn("batch", F.lit(2)).withColumn("i", F.lit(7).cast("bigint")))
    assert last_wins(twice).filter("group_key = 'A'").first().i == 7


def test_eval_json_and_pages(spark):
    rows = evaluate(series(spark), {"a": "A x", 'q"': "sum(B y)"})
    got = [json.loads(r.json) for r in as_json(rows, ["a", 'q"']).collect()]
    assert len(got) == 6 and got[1]["timestamp_msec"] == 1704067200000 + 21_600_000
    assert got[2]["metrics"]["a"][0]["value"] == "2" and got[2]["metrics"]['q"'][0]["value"] == "2.0"
    assert [len(p) for p in pages(rows, 5)] == [5, 5, 2]


def test_portions_resume(spark):
    """By size and by time; a cookie is good once; what fails is raised."""
    df, seen, cookie, portions = spark.range(0, 25, 1, 3), [], None, Portions(spark.range(0, 25, 1, 3), ahead=4)
    while True:
        p = portions.next(10, 60, cookie)
        seen.append(len(p.rows))
        if p.cookie is None:
            break
        with pytest.raises(LookupError):
            portions.next(10, 60, cookie or "other")
        cookie = p.cookie
    assert seen == [10, 10, 5]

    def slowly(batches):
        time.sleep(2)
        yield from batches

    slow = Portions(df.mapInPandas(slowly, "id long"))
    p = slow.next(25, 0.2)
    assert len(p.rows) < 25 and p.cookie
    rest = []
    while p.cookie:
        rest += p.rows
        p = slow.next(25, 20, p.cookie)
    assert sorted(r.id for r in rest + p.rows) == list(range(25))
    with pytest.raises(Exception, match="bad row"):
        Portions(df.selectExpr("raise_error('bad row') AS x")).next(5)


def test_configuration_files(tmp_path, capsys):
    (tmp_path / "inner.conf").write_text('collect collectd_push "p" as c; alert a if b c;')
    (tmp_path / "main.conf").write_text('import all from "inner.conf"; collect tcp as t { host = ["x"] } define q r = a b;')
    c = config.load(tmp_path / "main.conf")
    assert [x.kind for x in c.collects] == ["collectd_push", "tcp"] and len(c.rules) == 2
    assert cli.main(["check", "-r", str(tmp_path / "main.conf")]) == 0
    assert parse_configuration(capsys.readouterr().out.split("\n\n")[0])
    (tmp_path / "bad.conf").write_text("alert if;")
    assert cli.main(["check", str(tmp_path / "bad.conf")]) == 1
    (tmp_path / "loop.conf").write_text('import all from "loop.conf";')
    with pytest.raises(ValueError):
        config.load(tmp_path / "loop.conf")
    assert cli.main(["validate", "a b +"]) == 1 and cli.main(["validate", "a b + 1"]) == 0


def test_self_monitoring(spark):
    ds = series(spark)
    m = monitor.metrics(ds, spark.createDataFrame([(instant(2, 21600), 3)], "ts timestamp, failed long"), timings={"rules": 5.0})
    got = {(r.ts, r.metric_key): r for r in m.collect()}
    assert got[instant(1, 21600), "scrape.interval"].i == 21_600_000 and got[instant(0), "groups"].i == 2 and got[instant(0), "has_config_file"].b
    states = {(r.alert_key.split(".")[-1], r.ts): r.state for r in monitor.builtin_alerts(m, ds.scrapes).collect()}
    assert states["failure", instant(2, 21600)] == "TRIGGERING" and states["down", instant(2, 21600)] == "OK" and states["configuration_missing", instant(0)] == "OK"


RULES = 'define out v = rate(A x); alert hot if A x > 1 for 7h message "m"; alert mean if sum[13h](A x) > 6;'


def test_stream_equals_batch(spark, tmp_path):
    ds = series(spark, 8)
    batch = apply_rules(ds, parse_rules(RULES))
    want_points = sorted((r.ts, r.group_key, r.metric_key, r.i, r.d) for r in batch.dataset.points.collect())
    want = sorted((r.ts, r.alert_key, r.state, r.start) for r in batch.alerts.collect())
    h = History(spark, str(tmp_path / "h"))
    got = []

    for part in ((0, 1, 2), (3, 4), (5,), (6, 7)):  # micro-batches in order of time
        some = [instant(i, 21600) for i in part]
        new = Dataset(ds.points.filter(F.col("ts").isin(some)), ds.scrapes.filter(F.col("ts").isin(some)))
        out = engine.step(new, h, parse_rules(RULES))
        got += [(r.ts, r.alert_key, r.state, r.start) for r in out.alerts.collect()]
        h.append(out.dataset, part[0])
        h.append_alerts(out.alerts)
    assert sorted(got) == want
    assert sorted((r.ts, r.group_key, r.metric_key, r.i, r.d) for r in h.scan().points.collect()) == want_points


def test_streaming_query(spark, tmp_path):
    ds = series(spark, 3)
    ds.points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ds.points.schema).parquet(str(tmp_path / "in"))
    h, seen = History(spark, str(tmp_path / "h")), []
    q = engine.run(stream, parse_rules("define out v = A x * 2;"), [lambda p, a, f: seen.append(p.count())], str(tmp_path / "ck"), h, None)
    q.awaitTermination(120)
    assert sum(seen) == 9 and h.scan().points.filter("group_key = 'out'").count() == 3


def test_alert_state_store(spark, tmp_path):
    said = [True, True, None, None, False, None, True]
    rows = [(instant(i), i, "a", "[]", t) for i, t in enumerate(said)]
    del rows[3]
    spark.createDataFrame(rows, "ts timestamp, place long, alert_key string, tags_key string, triggered boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, place long, alert_key string, tags_key string, triggered boolean").parquet(str(tmp_path / "in"))
    q = engine.alert_stream(s, 60_000).writeStream.format("memory").queryName("alert_states").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [r.state for r in spark.sql("SELECT * FROM alert_states ORDER BY ts").collect()]
    assert got == ["TRIGGERING", "FIRING", "UNKNOWN", "OK", "UNKNOWN", "FIRING"]


def test_scans_push_down(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    h.append(series(spark))
    df = evaluate(h.scan(instant(1, 21600), instant(2, 21600)), {"x": "A x + 1"})
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    scan = plan[plan.index("/points") :].split("\n\n")[0]
    assert "EqualTo(group_key,A)" in scan and "EqualTo(metric_key,x)" in scan and "PartitionFilters: [isnotnull(date" in scan
    assert "group_path" not in scan and "metric_path" not in scan


def test_metrics_of_a_group_need_no_join(spark):
    ds = series(spark)
    plan = evaluate(ds, {"x": "A x * 2 + A y / A z"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan
