import datetime as dt
import json
import random
import socket
import struct
import time

import pytest

from rillflow.api import Config, Duration, Pipeline, Timestamp
from rillflow.errors import ForeignIo, InputTimeout, InvalidConfig, InvalidFormat, InvalidOption, NullValue, SqlError, TimeError, Unavailable
from rillflow.functions.values import convert_value
from rillflow.operators import windows
from rillflow.plans.parser import Bin, Col, Const, Neg, parse
from rillflow.sources.connectors import can_row
from rillflow.sources.rows import SinkRow, SourceRow, SourceRowBuilder, parse_time
from rillflow.streaming.live import Memory

TRADE = "CREATE SOURCE STREAM trade (ts TIMESTAMP NOT NULL ROWTIME, ticker TEXT NOT NULL, amount INTEGER NOT NULL);"
CITY = "CREATE SOURCE STREAM city (ts TIMESTAMP NOT NULL ROWTIME, city TEXT NOT NULL, temperature INTEGER NOT NULL);"
T4 = [("00:00.000000", "ORCL", 10), ("00:09.999999", "GOOGL", 30), ("00:10.000000", "IBM", 50), ("00:20.000000", "IBM", 70)]
S = 1_000_000


def at(text):
    return dt.datetime.fromisoformat(f"2020-01-01 00:{text}").replace(tzinfo=dt.UTC)


def trades(spark, rows, names="ts timestamp, ticker string, amount int, n long"):
    return spark.createDataFrame([(at(t), k, a, i) for i, (t, k, a) in enumerate(rows)], names)


def run(spark, rows, sink, pump, *more):
    p = Pipeline(spark)
    for c in (TRADE, *more, f"CREATE SINK STREAM s ({sink});", pump):
        p.command(c)
    return sorted(map(tuple, p.run_batch({"trade": (trades(spark, rows), ["n"])})["s"].collect()))


def test_average_without_group(spark):
    got = run(spark, T4, "a FLOAT NOT NULL", "CREATE PUMP p AS INSERT INTO s (a) SELECT STREAM AVG(trade.amount) AS x FROM trade FIXED WINDOW DURATION_SECS(10), DURATION_SECS(0);")
    assert got == [(20.0,), (50.0,)]


def test_sliding_average(spark):
    got = run(spark, T4, "ts TIMESTAMP NOT NULL ROWTIME, a FLOAT NOT NULL", "CREATE PUMP p AS INSERT INTO s (ts, a) SELECT STREAM FLOOR_TIME(trade.ts, DURATION_SECS(10)) AS m, AVG(trade.amount) AS x FROM trade GROUP BY m SLIDING WINDOW DURATION_SECS(10), DURATION_SECS(5), DURATION_SECS(0);")
    assert [(t.second, a) for t, a in got] == [(0, 10.0), (0, 20.0), (0, 30.0), (10, 50.0), (10, 50.0)]


LATE = [("00:00.000000", "GOOGL", 100), ("00:09.000000", "ORCL", 100), ("00:09.999999", "ORCL", 400), ("00:10.999999", "ORCL", 100), ("00:09.999998", "ORCL", 100), ("00:09.999999", "ORCL", 100), ("00:11.000000", "ORCL", 100), ("00:21.000000", "ORCL", 100)]


def test_late_rows_are_dropped_one_by_one(spark):
    got = run(spark, LATE, "k TEXT NOT NULL, a FLOAT NOT NULL", "CREATE PUMP p AS INSERT INTO s (k, a) SELECT STREAM trade.ticker AS k, AVG(trade.amount) AS x FROM trade GROUP BY k FIXED WINDOW DURATION_SECS(10), DURATION_SECS(1);")
    assert got == [("GOOGL", 100.0), ("ORCL", 100.0), ("ORCL", 200.0)]


def test_left_join(spark):
    p = Pipeline(spark)
    for c in (TRADE, CITY, "CREATE SINK STREAM s (ts TIMESTAMP NOT NULL ROWTIME, amount INTEGER NOT NULL, temperature INTEGER);", "CREATE PUMP p AS INSERT INTO s (ts, amount, temperature) SELECT STREAM trade.ts, trade.amount, c.temperature FROM trade LEFT OUTER JOIN city AS c ON trade.ts = c.ts FIXED WINDOW DURATION_SECS(10), DURATION_SECS(1);"):
        p.command(c)
    left = [("00:00.000000", "A", 100), ("00:09.999999", "A", 200), ("00:10.999999", "A", 300), ("00:09.999998", "A", 400), ("00:09.999999", "A", 500), ("00:11.000000", "A", 600)]
    right = trades(spark, [("00:00.000000", "Tokyo", 10)]).withColumnsRenamed({"ticker": "city", "amount": "temperature"})
    got = p.run_batch({"trade": (trades(spark, left), ["n"]), "city": (right, ["n"])})["s"].collect()
    assert sorted((r.amount, r.temperature) for r in got) == [(100, 10), (200, None), (500, None)]


def test_live_queues(spark):
    p = Pipeline(spark)
    for c in (TRADE, "CREATE SINK STREAM s (k TEXT NOT NULL, a FLOAT NOT NULL);", "CREATE PUMP p AS INSERT INTO s (k, a) SELECT STREAM trade.ticker AS k, AVG(trade.amount) AS x FROM trade GROUP BY k FIXED WINDOW DURATION_SECS(10), DURATION_SECS(1);", "CREATE SINK WRITER w FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SOURCE READER r FOR trade TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');"):
        p.command(c)
    for t, k, a in LATE:
        p.push("in", SourceRowBuilder().add_column("ts", at(t)).add_column("ticker", k).add_column("amount", a).build())
    p.start()
    try:
        got = sorted((r.get_not_null_by_index(0, str), r.get_not_null_by_index(1)) for r in (p.pop("out", 60) for _ in range(3)))
        assert p.pop_non_blocking("out") is None and p.metrics()["queues"][0]["window-queue"]["num-rows-waiting"] == 1
    finally:
        p.stop()
    assert got == [("GOOGL", 100.0), ("ORCL", 100.0), ("ORCL", 200.0)]


def test_expressions_bind_to_the_right():
    p = parse("CREATE PUMP p AS INSERT INTO s (a, b) SELECT STREAM e.a * e.b + 2, -e.a + 1 FROM e")
    one = Const(1, "SMALLINT")
    assert p.select[0][0] == Bin("*", Col("e", "a"), Bin("+", Col("e", "b"), Const(2, "SMALLINT")))
    assert p.select[1][0] == Neg(Bin("+", Col("e", "a"), one))


@pytest.mark.parametrize("sql", [
    "CREATE SOURCE STREAM x (ts INTEGER NOT NULL ROWTIME)", "CREATE SOURCE STREAM x (ts TIMESTAMP ROWTIME)", "CREATE STREAM trade (a TEXT)", "SELECT 1", "CREATE STREAM x (a NUMBER)",
    "CREATE PUMP p AS INSERT INTO s (a) SELECT STREAM trade.ticker + 1 FROM trade", "CREATE PUMP p AS INSERT INTO s (a) SELECT STREAM trade.nothing FROM trade",
    "CREATE PUMP p AS INSERT INTO s (a) SELECT STREAM AVG(trade.amount) AS x FROM trade", "CREATE PUMP p AS INSERT INTO s (a, a) SELECT STREAM 1, 2 FROM trade", "CREATE PUMP p AS INSERT INTO s (a) SELECT STREAM trade.ptime FROM trade",
])
def test_wrong_statements(spark, sql):
    p = Pipeline(spark)
    p.command(TRADE)
    p.command("CREATE SINK STREAM s (a INTEGER NOT NULL)")
    with pytest.raises(SqlError):
        p.command(sql)


def test_edges(spark):
    p = Pipeline(spark)
    p.command(TRADE)
    with pytest.raises(InvalidOption):
        p.command("CREATE SOURCE READER r FOR trade TYPE NET_CLIENT OPTIONS (PROTOCOL 'UDP')")
    with pytest.raises(Unavailable):
        p.pop("nowhere")
    with pytest.raises(InvalidFormat):
        SourceRow.from_json("[1]")
    with pytest.raises(SqlError):
        SourceRowBuilder().add_column("a", 1).add_column("a", 2)
    with pytest.raises(NullValue):
        SinkRow(["a"], [None]).get_not_null_by_index(0)
    with pytest.raises(InvalidConfig):
        Config.from_toml("[nothing]\nx = 1")
    assert Config.from_toml("[memory]\nupper_limit_bytes = 5").memory["upper_limit_bytes"] == 5
    assert parse_time("2021-01-01 13:00:00.123456789") == parse_time("2021-01-01T22:00:00.123456+09:00")
    p.command("CREATE SINK STREAM s (a TEXT)")
    p.command("CREATE PUMP p AS INSERT INTO s (a) SELECT STREAM trade.ticker FROM trade")
    p.command("CREATE SINK WRITER w FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'q')")
    with pytest.raises(InputTimeout):
        p.pop("q", 0.1)


def queues(spark, source, sink, pump, config=None):
    p = Pipeline(spark, config)
    for c in (f"CREATE SOURCE STREAM s ({source});", f"CREATE SINK STREAM o ({sink});", pump, "CREATE SINK WRITER w FOR o TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SOURCE READER r FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'in');"):
        p.command(c)
    return p


def test_typed_rows_keep_their_digits_and_misfits_are_left_out(spark):
    kinds = "a INTEGER NOT NULL, b BIGINT, c UNSIGNED BIGINT, d BLOB, e BOOLEAN, f FLOAT, t TIMESTAMP"
    p = queues(spark, kinds, kinds, "CREATE PUMP p AS INSERT INTO o (a, b, c, d, e, f, t) SELECT STREAM s.a, s.b, s.c, s.d, s.e, s.f, s.t FROM s;")
    when = Timestamp.parse("2020-01-01 00:00:05.123456789")
    good = {"a": 123456789, "b": -(1 << 63), "c": (1 << 64) - 1, "d": b"\x00\xff", "e": True, "f": 1.5, "t": when}
    p.start()
    try:
        for change in ({"a": 1 << 31}, {"a": "text"}, {"a": None}, {"c": -1}, {"d": 5}, {"e": "true"}, {"t": "not a time"}):
            p.push("in", SourceRow({**good, **change}))
        p.push("in", SourceRow({**good, "b": None}))
        p.push("in", SourceRow(good))
        empty, row = p.pop("out", 60), p.pop("out", 60)
    finally:
        p.stop()
    with pytest.raises(NullValue):
        empty.get_not_null_by_index(1)
    assert [row.get_not_null_by_index(i, k) for i, k in enumerate((int, "BIGINT", "UNSIGNED BIGINT", bytes, bool, float, str))] == [123456789, -(1 << 63), (1 << 64) - 1, b"\x00\xff", True, 1.5, "2020-01-01 00:00:05.123456000"]
    assert row.get_not_null_by_index(6, dt.datetime) == dt.datetime(2020, 1, 1, 0, 0, 5, 123456)
    again = SourceRow.from_sink(row)
    assert again.types["c"] == "UNSIGNED BIGINT" and json.loads(again.typed())["c"]["v"] == str((1 << 64) - 1)
    for i, kind in ((0, "SMALLINT"), (2, "BIGINT"), (3, str), (4, int), (9, int)):
        with pytest.raises(SqlError):
            row.get_not_null_by_index(i, kind)


def test_values():
    t = Timestamp.parse("2021-01-01T22:00:00.123456789+09:00")
    assert str(t) == "2021-01-01 13:00:00.123456789" and t == Timestamp.parse(str(t)) and Timestamp.of(t.datetime()).ns == t.ns - 789
    assert str(t.floor(Duration.secs(60))) == "2021-01-01 13:00:00.000000000" and str(t.ceil(Duration.millis(250))) == "2021-01-01 13:00:00.250000000"
    for text in ("yesterday", "2021-13-01 00:00:00.000000000"):
        with pytest.raises(TimeError):
            Timestamp.parse(text)
    with pytest.raises(TimeError):
        Duration.secs(-1)
    assert convert_value(3.2, "FLOAT", "INTEGER") == 4 and convert_value(1e30, "FLOAT", "SMALLINT") == 32767 and convert_value(16777217, "BIGINT", "FLOAT") == 16777216.0


JOIN = "CREATE PUMP p AS INSERT INTO s (ts, amount, temperature) SELECT STREAM trade.ts, trade.amount, c.temperature FROM trade LEFT OUTER JOIN city AS c ON trade.ts = c.ts FIXED WINDOW DURATION_SECS(10), DURATION_SECS(1);"


def test_live_join_knows_the_order_between_streams_and_keeps_microseconds(spark):
    p = Pipeline(spark)
    for c in (TRADE, CITY, "CREATE SINK STREAM s (ts TIMESTAMP NOT NULL ROWTIME, amount INTEGER NOT NULL, temperature INTEGER);", JOIN, "CREATE SINK WRITER w FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out');", "CREATE SINK WRITER w2 FOR s TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'out2');",
              "CREATE SOURCE READER r FOR trade TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'left');", "CREATE SOURCE READER r2 FOR city TYPE IN_MEMORY_QUEUE OPTIONS (NAME 'right');"):
        p.command(c)
    row = lambda t, n, v, k: SourceRowBuilder().add_column("ts", at(t)).add_column(n, "x").add_column(k, v).build()
    p.start()
    try:
        for t, v in (("00:05.123456", 7), ("00:06.000000", 8)):
            p.push("right", row(t, "city", v, "temperature"))
        waits(lambda: p._landing.n == 2)
        for t, v in (("00:05.123456", 1), ("00:09.000000", 2), ("00:30.000000", 3)):
            p.push("left", row(t, "ticker", v, "amount"))
        got = [[tuple(p.pop(q, 60).values) for _ in range(2)] for q in ("out", "out2")]
    finally:
        p.stop()
    assert got[0] == got[1] == [(dt.datetime(2020, 1, 1, 0, 0, 5, 123456), 1, 7), (dt.datetime(2020, 1, 1, 0, 0, 9), 2, None)]


def waits(condition):
    end = time.time() + 60
    while not condition():
        assert time.time() < end
        time.sleep(0.05)


def test_open_panes_are_purged_beyond_the_limit(spark):
    p = queues(spark, "ts TIMESTAMP NOT NULL ROWTIME, v INTEGER NOT NULL", "a FLOAT NOT NULL", "CREATE PUMP p AS INSERT INTO o (a) SELECT STREAM AVG(s.v) AS x FROM s FIXED WINDOW DURATION_SECS(10), DURATION_SECS(0);", Config.from_toml("[memory]\nupper_limit_bytes = 100"))
    push = lambda t, v: p.push("in", SourceRowBuilder().add_column("ts", at(t)).add_column("v", v).build())
    p.start()
    try:
        push("00:01.000000", 100)
        waits(lambda: p._memory.state == "Critical" and not p._flow.states["p-average"].rows)
        push("00:20.000000", 1)  # would have closed the pane
        waits(lambda: p._flow.states["p-average"].top == 1577836820 * S)
        assert p.pop_non_blocking("out") is None
    finally:
        p.stop()


def test_memory_states():
    m = Memory({"upper_limit_bytes": 100, "moderate_to_severe_percent": 60, "severe_to_critical_percent": 95, "critical_to_severe_percent": 80, "severe_to_moderate_percent": 40})
    assert [m.see(x) for x in (59, 60, 94, 95, 81, 80, 41, 40)] == ["Moderate", "Severe", "Severe", "Critical", "Critical", "Severe", "Severe", "Moderate"]


def test_peers_that_cannot_be_reached(spark):
    with socket.create_server(("127.0.0.1", 0)) as s:
        free = s.getsockname()[1]
    for command in ("CREATE SOURCE READER r FOR s TYPE NET_CLIENT", "CREATE SINK WRITER w FOR o TYPE NET_CLIENT"):
        p = Pipeline(spark)
        p.command("CREATE SOURCE STREAM s (a TEXT)")
        p.command("CREATE SINK STREAM o (a TEXT)")
        p.command(f"{command} OPTIONS (REMOTE_HOST '127.0.0.1', REMOTE_PORT '{free}')")
        with pytest.raises(ForeignIo):
            p.start()
        p.stop()
    for frame in (0x20000001, 0x80000001, 0x40000001):
        with pytest.raises(ForeignIo):
            can_row(struct.pack("=IB3x8s", frame, 1, b"x"))


def test_a_failing_reader_is_told(spark):
    p = queues(spark, "a TEXT", "a TEXT", "CREATE PUMP p AS INSERT INTO o (a) SELECT STREAM s.a FROM s;")
    p.start()
    try:
        p.inputs["in"].put(5)  # not a row
        waits(lambda: p._readers[0].error is not None)
        with pytest.raises(ForeignIo):
            p.pop("out", 5)
    finally:
        p.stop()


@pytest.mark.parametrize("keys", [lambda i: [0 if i % 100 else i, i], lambda i: [None if i % 3 == 0 else i // 40, i], lambda i: [i]])
def test_lateness_with_uneven_arrival_keys(spark, monkeypatch, keys):
    monkeypatch.setattr(windows, "RANGE_ROWS", 16)
    r = random.Random(4)
    rows = [(keys(i), r.randrange(1000)) for i in range(3000)]
    df = spark.createDataFrame([(k, t) for k, t in rows], "__seq array<bigint>, __rt bigint").repartition(5)
    top, want = None, []
    for k, t in sorted(rows, key=lambda x: [(v is not None, v or 0) for v in x[0]]):
        if top is None or t >= top - 300:
            want.append((k, t))
        top = t if top is None else max(top, t)
    got, last = windows.on_time(df, 300)
    assert last == top and sorted(map(str, ((x["__seq"], x["__rt"]) for x in got.collect()))) == sorted(map(str, want))
    assert {x["__rt"] for x in windows.on_time(df, 300, 1200)[0].collect()} == {t for _, t in want if t >= 900}


def test_settings():
    c = Config.from_toml("[worker]\nsleep_msec_no_row = 10\n[web_console]\nhost = 'h'")
    assert c.worker["sleep_msec_no_row"] == 10 and c.web_console["port"] == 8050 and not c.purges
    for text in ("[memory]\nnothing = 1", "[memory]\nupper_limit_bytes = 'x'", "[worker", "[worker]\nsleep_msec_no_row = -1"):
        with pytest.raises(InvalidConfig):
            Config.from_toml(text)
