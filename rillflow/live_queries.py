"""Queries that run the live engine: micro-batches with state, queues, network and HTTP connectors, typed rows, reports."""

from __future__ import annotations

import contextlib
import http.server
import json
import queue
import socket
import struct
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Config, Pipeline, SourceRow, SourceRowBuilder
from .queries import EVENTS, HOUR, JOIN, JOINED, KEYS, _GROUP, _SELECT, events, into, plain, sql_avg, sql_floor, sql_join
from .sources.connectors import can_row
from .sources.rows import from_json, from_typed

BATCHES = 5


def replayed(sink: str, pump: str, *more: str) -> Callable[[SparkSession, str], DataFrame]:
    """A pump over all events in micro-batches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = declared(spark, f"CREATE SOURCE STREAM e ({EVENTS});", *more, f"CREATE SINK STREAM out_s ({sink});", pump)
        return plain(p.replay({"e": (events(spark, sf_dir), "event_id")}, BATCHES)["out_s"])

    return run


def replayed_join(sink: str, pump: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = declared(spark, f"CREATE SOURCE STREAM l ({EVENTS});", f"CREATE SOURCE STREAM r ({EVENTS});", f"CREATE SINK STREAM out_s ({sink});", pump)
        e = events(spark, sf_dir).withColumn("n", F.col("event_id") * 2)
        return plain(p.replay({"l": (e.filter("event_type = 'click'"), "n"), "r": (e.filter("event_type = 'purchase'").withColumn("n", F.col("n") + 1), "n")}, BATCHES)["out_s"])

    return run


def declared(spark: SparkSession, *commands: str, config: Config | None = None) -> Pipeline:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    p = Pipeline(spark, config)
    for c in commands:
        p.command(c)
    return p


@contextlib.contextmanager
def running(p: Pipeline):
    p.start()
    try:
        yield p
    finally:
        p.stop()


def nations(spark: SparkSession, sf_dir: str) -> list:
    """The rows of a table that has 25 at every size."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()


def queue_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built rows through queues: integers that FLOAT couldn't hold, unsigned ones and times, read by typed getters."""
    p = declared(
        spark, "CREATE SOURCE STREAM s (ts TIMESTAMP NOT NULL ROWTIME, k UNSIGNED INTEGER NOT NULL, big BIGINT NOT NULL, name TEXT NOT NULL);",
        "CREATE SINK STREAM out_s (ts TIMESTAMP NOT NULL ROWTIME, k UNSIGNED INTEGER NOT NULL, big BIGINT NOT NULL, name TEXT NOT NULL);", into("name, ts, big, k", "x.name, x.ts, x.big, x.k", "FROM s AS x"),
        "CREATE SINK WRITER w FOR out_s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SOURCE READER r FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');",
    )
    rows = nations(spark, sf_dir)
    with running(p):
        for r in rows:
            p.push("in", SourceRowBuilder().add_column("ts", f"2020-01-01 00:00:{r.n_nationkey:02d}.123456000").add_column("k", r.n_nationkey).add_column("big", 9007199254740993 + r.n_nationkey).add_column("name", r.n_name).build())
        got = [p.pop("out", 120) for _ in rows]
    return spark.createDataFrame([(g.get_not_null_by_index(0, str), g.get_not_null_by_index(1, int), g.get_not_null_by_index(2, "BIGINT"), g.get_not_null_by_index(3, str)) for g in got], "ts string, k long, big long, name string")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes through queues."""
    p = declared(
        spark, "CREATE SOURCE STREAM s (body BLOB NOT NULL);", "CREATE SINK STREAM out_s (body BLOB NOT NULL);", into("body", "s.body", "FROM s"),
        "CREATE SINK WRITER w FOR out_s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SOURCE READER r FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');",
    )
    rows = nations(spark, sf_dir)
    with running(p):
        for r in rows:
            p.push("in", SourceRowBuilder().add_column("body", b"\xff\x00" + r.n_name.encode()).build())
        got = [p.pop("out", 120).get_not_null_by_index(0, bytes) for _ in rows]
    return spark.createDataFrame([(b.hex().upper(),) for b in got], "body string")


def ptimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing times of rows without ROWTIME: how many there are, and whether they never go back."""
    p = declared(
        spark, "CREATE SOURCE STREAM s (name TEXT NOT NULL);", "CREATE SINK STREAM out_s (ts TIMESTAMP NOT NULL ROWTIME, name TEXT NOT NULL);", into("ts, name", "s.ptime, s.name", "FROM s"),
        "CREATE SINK WRITER w FOR out_s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SOURCE READER r FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');",
    )
    rows = nations(spark, sf_dir)
    with running(p):
        for r in rows:
            p.push("in", SourceRowBuilder().add_column("name", r.n_name).build())
        got = [p.pop("out", 120).get_not_null_by_index(0, str) for _ in rows]
    return spark.createDataFrame([(len(got), got == sorted(got))], "n long, in_order boolean")


def two_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline's sink rows pushed into another: n + 1, then times 10."""
    ends = ["CREATE SINK WRITER w FOR out_s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SOURCE READER r FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');"]
    streams = ["CREATE SOURCE STREAM s (n BIGINT NOT NULL);", "CREATE SINK STREAM out_s (n BIGINT NOT NULL);"]
    a, b = (declared(spark, *streams, into("n", e, "FROM s"), *ends) for e in ("s.n + 1", "s.n * 10"))
    rows = nations(spark, sf_dir)
    with running(a), running(b):
        for r in rows:
            a.push("in", SourceRow.from_json(json.dumps({"n": r.n_nationkey})))
        for _ in rows:
            b.push("in", SourceRow.from_sink(a.pop("out", 120)))
        got = [b.pop("out", 120).get_not_null_by_index(0, "BIGINT") for _ in rows]
    return spark.createDataFrame([(n,) for n in got], "n long")


class Listener:
    """A TCP peer on this machine: gives its lines to whoever connects, and keeps the lines that it's sent."""

    def __init__(self, lines: list[str] = ()):
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.port, self.lines, self.got = self.socket.getsockname()[1], lines, queue.Queue()
        threading.Thread(target=self.run, daemon=True).start()

    def run(self) -> None:
        s, _ = self.socket.accept()
        with s:
            s.sendall("".join(x + "\n" for x in self.lines).encode())
            s.shutdown(socket.SHUT_WR)
            with s.makefile() as f:
                for line in f:
                    self.got.put(line)


def free_port() -> int:
    with socket.create_server(("127.0.0.1", 0)) as s:
        return s.getsockname()[1]


WIRE = "ts TIMESTAMP NOT NULL ROWTIME, name TEXT NOT NULL, n INTEGER NOT NULL"


def wire_rows(spark: SparkSession, sf_dir: str) -> list[str]:
    return [json.dumps({"ts": f"2020-01-01 00:00:{r.n_nationkey:02d}.000000000", "name": r.n_name, "n": r.n_nationkey}) for r in nations(spark, sf_dir)]


def from_wire(spark: SparkSession, got: list[str]) -> DataFrame:
    rows = [json.loads(x) for x in got]
    return spark.createDataFrame([(r["ts"], r["name"], r["n"]) for r in rows], "ts string, name string, n long")


def net_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines from a server, through a projection, to another server."""
    rows = wire_rows(spark, sf_dir)
    source, sink = Listener(rows), Listener()
    p = declared(
        spark, f"CREATE SOURCE STREAM s ({WIRE});", f"CREATE SINK STREAM out_s ({WIRE});", into("ts, name, n", "s.ts, s.name, s.n * 2", "FROM s"),
        f"CREATE SINK WRITER w FOR out_s TYPE NET_CLIENT OPTIONS (PROTOCOL 'TCP', REMOTE_HOST '127.0.0.1', REMOTE_PORT '{sink.port}');", f"CREATE SOURCE READER r FOR s TYPE NET_CLIENT OPTIONS (PROTOCOL 'TCP', REMOTE_HOST '127.0.0.1', REMOTE_PORT '{source.port}');",
    )
    with running(p):
        got = [sink.got.get(timeout=120) for _ in rows]
    return from_wire(spark, got)


def net_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines from a client that connects, some of which don't fit and are left out."""
    rows, port = wire_rows(spark, sf_dir), free_port()
    p = declared(
        spark, f"CREATE SOURCE STREAM s ({WIRE});", f"CREATE SINK STREAM out_s ({WIRE});", into("ts, name, n", "s.ts, s.name, s.n", "FROM s"),
        "CREATE SINK WRITER w FOR out_s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", f"CREATE SOURCE READER r FOR s TYPE NET_SERVER OPTIONS (PROTOCOL 'TCP', PORT '{port}');",
    )
    with running(p):
        with socket.create_connection(("127.0.0.1", port)) as s:
            s.sendall("\n".join(["no object", '{"ts": 5, "name": "x", "n": 1}', *rows, '{"name": "no time", "n": 1}', ""]).encode())
        got = [p.pop("out", 120) for _ in rows]
    return spark.createDataFrame([tuple(g.get_not_null_by_index(i, t) for i, t in enumerate((str, str, int))) for g in got], "ts string, name string, n long")


@contextlib.contextmanager
def console():
    """An HTTP server on this machine that keeps what is posted: (path, headers, body)."""
    got: queue.Queue = queue.Queue()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.put((self.path, dict(self.headers), self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield server.server_address[1], got
    finally:
        server.shutdown()


SLOW = Config.from_toml("[sink_writer]\nhttp_timeout_msec = 5000")


def http_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies posted by HTTP, with a header."""
    rows = nations(spark, sf_dir)
    with console() as (port, got):
        p = declared(
            spark, "CREATE SOURCE STREAM s (body BLOB NOT NULL);", "CREATE SINK STREAM out_s (body BLOB NOT NULL);", into("body", "s.body", "FROM s"),
            f"CREATE SINK WRITER w FOR out_s TYPE HTTP1_CLIENT OPTIONS (REMOTE_HOST '127.0.0.1', REMOTE_PORT '{port}', METHOD 'POST', URL 'http://127.0.0.1:{port}/in', HEADER_X_Kind 'nation', BLOB_BODY_COLUMN 'body');",
            "CREATE SOURCE READER r FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');", config=SLOW,
        )
        with running(p):
            for r in rows:
                p.push("in", SourceRowBuilder().add_column("body", r.n_name.encode()).build())
            posted = [got.get(timeout=120) for _ in rows]
    return spark.createDataFrame([(path, headers["X_Kind"], body.decode()) for path, headers, body in posted], "path string, kind string, body string")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the web console is sent about a running pipeline: its tasks and queues."""
    with console() as (port, got):
        p = declared(
            spark, "CREATE SOURCE STREAM s (n BIGINT NOT NULL);", "CREATE SINK STREAM out_s (n BIGINT NOT NULL);", into("n", "s.n", "FROM s"),
            "CREATE SINK WRITER w FOR out_s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SOURCE READER r FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');",
            config=Config.from_toml(f'[web_console]\nenable_report_post = true\nport = {port}\nreport_interval_msec = 200'),
        )
        with running(p):
            path, _, body = got.get(timeout=60)
    sent = json.loads(body)
    rows = [(path, x["type"], x["id"], "", "") for x in sent["tasks"] if isinstance(x["avg-gain-bytes-per-sec"], (int, float))]
    rows += [(path, "row-queue", x["id"], x["upstream-task-id"], x["downstream-task-id"]) for x in sent["queues"] if set(x["row-queue"]) == {"num-rows", "total-bytes"}]
    return spark.createDataFrame(rows, "path string, kind string, id string, up string, down string")


def can_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as a CAN socket gives them, as rows: can_id UNSIGNED INTEGER, can_data BLOB."""
    p = declared(spark, "CREATE SOURCE STREAM s (can_id UNSIGNED INTEGER NOT NULL, can_data BLOB NOT NULL);", "CREATE SINK STREAM out_s (can_id UNSIGNED INTEGER NOT NULL, can_data BLOB NOT NULL);", into("can_id, can_data", "s.can_id, s.can_data", "FROM s"))
    frames = [struct.pack("=IB3x8s", r.n_nationkey, 4, r.n_name.encode()[:4]) for r in nations(spark, sf_dir)]
    lines = spark.createDataFrame([(i, can_row(f).typed()) for i, f in enumerate(frames)], "n long, value string").select("value", F.array("n").alias("__seq"))
    out = p.frames({"s": from_typed(lines, p.streams["s"])}, lambda q, f: q.batch(f))["out_s"]
    return out.select("can_id", F.hex("can_data").alias("can_data"))


def misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values of other kinds than their columns', in nullable ones too: those rows are left out."""
    p = declared(spark, "CREATE SOURCE STREAM s (event_id INTEGER NOT NULL, kind TEXT, value FLOAT);")
    e = events(spark, sf_dir)
    text = F.when(F.col("event_id") % 5 == 0, F.lit('"text"')).when(F.col("event_id") % 5 == 1, F.lit("null")).when(F.col("event_id") % 5 == 2, F.lit("[1]")).otherwise(F.lit("2.5"))
    kind = F.when(F.col("event_id") % 7 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    lines = e.select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "kind": '), kind, F.lit(', "value": '), text, F.lit("}")).alias("value"), F.array("event_id").alias("__seq"))
    return plain(from_json(lines, p.streams["s"]).select("event_id", "kind", "value"))


DAY = 24 * HOUR
_HOURLY = sql_avg(HOUR, HOUR, 60_000_000, f"ts := {sql_floor('ts', HOUR)}, event_type := event_type")
NATION = "SELECT strftime(TIMESTAMP '2020-01-01' + to_seconds(n_nationkey), '%Y-%m-%d %H:%M:%S') || '.000000000' AS ts, n_name AS name, CAST({} AS BIGINT) AS n FROM nation"

QUERIES = {
    "stream_fixed_avg_exact": replayed(KEYS, into("ts, event_type, avg_value", _SELECT, _GROUP)),
    "stream_sliding_avg_exact": replayed("event_type TEXT NOT NULL, avg_value FLOAT NOT NULL", into("event_type, avg_value", "e.event_type AS k, AVG(e.value) AS a", "FROM e GROUP BY k SLIDING WINDOW DURATION_SECS(7200), DURATION_SECS(1800), DURATION_SECS(60)")),
    "stream_left_join_exact": replayed_join(JOINED, into("ts, event_id, other", "l.ts, l.event_id, r.event_id", f"{JOIN} FIXED WINDOW DURATION_SECS(86400), DURATION_SECS(60)")),
    "stream_join_then_avg": replayed_join("user_id BIGINT NOT NULL, avg_value FLOAT NOT NULL", into("user_id, avg_value", "l.user_id AS u, AVG(l.value) AS a", f"{JOIN} GROUP BY u FIXED WINDOW DURATION_SECS(86400), DURATION_SECS(60)")),
    "stream_chained_avg": replayed(
        "day TIMESTAMP NOT NULL ROWTIME, avg_value FLOAT NOT NULL", into("day, avg_value", "FLOOR_TIME(m.ts, DURATION_SECS(86400)) AS d, AVG(m.avg_value) AS a", "FROM m GROUP BY d FIXED WINDOW DURATION_SECS(86400), DURATION_SECS(0)"),
        f"CREATE STREAM m ({KEYS});", into("ts, event_type, avg_value", _SELECT, "FROM e GROUP BY t, k FIXED WINDOW DURATION_SECS(3600), DURATION_SECS(60)", name="first", target="m"),
    ),
    "push_pop_roundtrip": queue_in_out,
    "blob_passthrough": blobs,
    "ptime_monotone": ptimes,
    "two_pipelines": two_pipelines,
    "net_client_in_out": net_client,
    "net_server_in": net_server,
    "http_sink": http_sink,
    "web_console_report": report,
    "can_frames": can_frames,
    "json_misfits_left_out": misfits,
}

ORACLES = {
    "stream_fixed_avg_exact": sql_avg(HOUR, HOUR, 0, f"ts := {sql_floor('ts', HOUR)}, event_type := event_type"),
    "stream_sliding_avg_exact": sql_avg(2 * HOUR, HOUR // 2, 60_000_000, "event_type := event_type"),
    "stream_left_join_exact": sql_join(DAY, DAY, 60_000_000) + " SELECT ts, event_id, other FROM joined",
    "stream_join_then_avg": sql_join(DAY, DAY, 60_000_000) + ", top AS (SELECT max(epoch_us(ts)) - 60000000 AS w FROM joined) SELECT user_id, CAST(round(avg(CAST(lvalue AS DOUBLE))) AS DOUBLE) AS avg_value FROM joined, top WHERE o + 86400000000 <= w GROUP BY o, user_id",
    "stream_chained_avg": f"WITH m AS ({_HOURLY}), wm AS (SELECT max(epoch_us(ts)) AS wm FROM m) SELECT {sql_floor('ts', DAY)} AS day, CAST(round(avg(avg_value)) AS DOUBLE) AS avg_value FROM m, wm WHERE epoch_us(ts) - epoch_us(ts) % {DAY} + {DAY} <= wm GROUP BY 1",
    "push_pop_roundtrip": "SELECT strftime(TIMESTAMP '2020-01-01' + to_seconds(n_nationkey), '%Y-%m-%d %H:%M:%S') || '.123456000' AS ts, CAST(n_nationkey AS BIGINT) AS k, CAST(9007199254740993 + n_nationkey AS BIGINT) AS big, n_name AS name FROM nation",
    "blob_passthrough": "SELECT 'FF00' || hex(n_name) AS body FROM nation",
    "ptime_monotone": "SELECT count(*) AS n, true AS in_order FROM nation",
    "two_pipelines": "SELECT CAST((n_nationkey + 1) * 10 AS BIGINT) AS n FROM nation",
    "net_client_in_out": NATION.format("n_nationkey * 2"),
    "net_server_in": NATION.format("n_nationkey"),
    "http_sink": "SELECT '/in' AS path, 'nation' AS kind, n_name AS body FROM nation",
    "web_console_report": "SELECT * FROM (VALUES ('/task-graph', 'source-task', 'r', '', ''), ('/task-graph', 'pump-task', 'p', '', ''), ('/task-graph', 'sink-task', 'w', '', ''), ('/task-graph', 'row-queue', 's-p', 'r', 'p'), ('/task-graph', 'row-queue', 'out_s-w', 'p', 'w')) t(path, kind, id, up, down)",
    "can_frames": "SELECT CAST(n_nationkey AS BIGINT) AS can_id, hex(n_name[1:4]) AS can_data FROM nation",
    "json_misfits_left_out": "SELECT CAST(event_id AS INTEGER) AS event_id, event_type AS kind, CASE WHEN event_id % 5 = 1 THEN NULL ELSE CAST(2.5 AS DOUBLE) END AS value FROM events WHERE event_id % 5 IN (1, 3, 4) AND event_id % 7 <> 0",
}
