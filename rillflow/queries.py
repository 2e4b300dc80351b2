"""The engine's queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Pipeline

EVENTS = "ts TIMESTAMP NOT NULL ROWTIME, event_id BIGINT NOT NULL, user_id BIGINT NOT NULL, event_type TEXT NOT NULL, value FLOAT NOT NULL"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df: DataFrame) -> DataFrame:
    """Types that DuckDB's results have: TIMESTAMP without zone, DOUBLE for FLOAT."""
    cast = {"timestamp": "timestamp_ntz", "float": "double"}
    return df.select(*[F.col(c).cast(cast[t]) if t in cast else F.col(c) for c, t in df.dtypes])


def pipeline(spark: SparkSession, *commands: str) -> Pipeline:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    p = Pipeline(spark)
    for c in commands:
        p.command(c)
    return p


def over_events(sink: str, pump: str, *more: str, order: tuple[str, ...] = ("event_id",), result: str = "out_s"):
    """A query of one pump (and what goes before it) over the events in this arrival order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = pipeline(spark, f"CREATE SOURCE STREAM e ({EVENTS});", *more, f"CREATE SINK STREAM out_s ({sink});", pump)
        return plain(p.run_batch({"e": (events(spark, sf_dir), list(order))})[result])

    return run


def into(columns: str, select: str, rest: str = "FROM e", name: str = "p", target: str = "out_s") -> str:
    return f"CREATE PUMP {name} AS INSERT INTO {target} ({columns}) SELECT STREAM {select} {rest};"


def _two(left: str, right: str, sink: str, pump: str, *more: str):
    """Clicks and purchases as two streams, joined."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = pipeline(spark, f"CREATE SOURCE STREAM l ({EVENTS});", f"CREATE SOURCE STREAM r ({EVENTS});", *more, f"CREATE SINK STREAM out_s ({sink});", pump)
        e = events(spark, sf_dir)
        return plain(p.run_batch({"l": (e.filter(F.col("event_type") == left), ["event_id"]), "r": (e.filter(F.col("event_type") == right), ["event_id"])})["out_s"])

    return run


HOUR = 3_600_000_000


def sql_floor(x: str, us: int) -> str:
    return f"make_timestamp(epoch_us({x}) - epoch_us({x}) % {us})"


def sql_late(delay: int, order: str) -> str:
    return f"""
        late AS (SELECT *, max(ts) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM events),
        live AS (SELECT * FROM late WHERE pm IS NULL OR epoch_us(ts) >= epoch_us(pm) - {delay}),
        wm AS (SELECT max(epoch_us(ts)) - {delay} AS wm FROM events)"""


def sql_avg(length: int, period: int, delay: int, keys: str, order: str = "event_id", head: str = "") -> str:
    """Average of value for each pane and keys; keys: name := expression, ..."""
    pairs = [k.split(" := ") for k in keys.split(", ")] if keys else []
    sel = "".join(f"{e} AS {n}, " for n, e in pairs)
    n = -(-length // period)
    return f"""
        WITH {sql_late(delay, order)},
        panes AS (SELECT *, epoch_us(ts) - epoch_us(ts) % {period} - k * {period} AS o FROM live, range({n}) t(k))
        SELECT {sel}CAST(round(avg(CAST(CAST(value AS FLOAT) AS DOUBLE))) AS DOUBLE) AS avg_value
        FROM panes, wm WHERE o > epoch_us(ts) - {length} AND o + {length} <= wm GROUP BY o, wm{"".join(", " + e for _, e in pairs)}"""


def sql_join(length: int, period: int, delay: int) -> str:
    n = -(-length // period)
    return f"""
        WITH both_s AS (SELECT *, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS side FROM events WHERE event_type IN ('click', 'purchase')),
        late AS (SELECT *, max(ts) OVER (ORDER BY event_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM both_s),
        wm AS (SELECT max(epoch_us(ts)) - {delay} AS wm FROM both_s),
        panes AS (SELECT late.*, epoch_us(ts) - epoch_us(ts) % {period} - k * {period} AS o FROM late, range({n}) t(k) WHERE pm IS NULL OR epoch_us(ts) >= epoch_us(pm) - {delay}),
        live AS (SELECT * FROM panes, wm WHERE o > epoch_us(ts) - {length} AND o + {length} <= wm),
        joined AS (SELECT l.ts, l.o, l.user_id, l.event_id, r.event_id AS other, CAST(r.value AS FLOAT) AS rvalue, CAST(l.value AS FLOAT) AS lvalue
                   FROM (SELECT * FROM live WHERE side = 0) l LEFT JOIN (SELECT * FROM live WHERE side = 1) r ON l.o = r.o AND l.user_id = r.user_id)"""


KEYS = "ts TIMESTAMP NOT NULL ROWTIME, event_type TEXT NOT NULL, avg_value FLOAT NOT NULL"
_FIXED = "FIXED WINDOW DURATION_SECS(3600), DURATION_SECS(0)"
_GROUP = f"FROM e GROUP BY t, k {_FIXED}"
_SELECT = "FLOOR_TIME(e.ts, DURATION_SECS(3600)) AS t, e.event_type AS k, AVG(e.value) AS a"
JOINED = "ts TIMESTAMP NOT NULL ROWTIME, event_id BIGINT NOT NULL, other BIGINT"
JOIN = "FROM l LEFT OUTER JOIN r ON l.user_id = r.user_id"


def _unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and products of unsigned columns."""
    p = pipeline(spark, "CREATE SOURCE STREAM e (event_id BIGINT NOT NULL, user_id UNSIGNED INTEGER NOT NULL);", "CREATE SINK STREAM out_s (event_id BIGINT NOT NULL, a UNSIGNED BIGINT NOT NULL, b UNSIGNED INTEGER NOT NULL);", into("event_id, a, b", "e.event_id, e.user_id * e.user_id, e.user_id + e.user_id"))
    out = p.run_batch({"e": (events(spark, sf_dir).select("event_id", "user_id"), ["event_id"])})["out_s"]
    return out.select("event_id", F.col("a").cast("bigint").alias("a"), "b")


def push_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as JSON through a projection, as a source reads them."""
    from .sources.rows import from_json, to_json

    p = pipeline(spark, "CREATE SOURCE STREAM s (ts TIMESTAMP NOT NULL ROWTIME, user_id INTEGER NOT NULL, event_type TEXT NOT NULL);", "CREATE SINK STREAM out_s (ts TIMESTAMP NOT NULL ROWTIME, user_id INTEGER NOT NULL, event_type TEXT NOT NULL);", into("ts, user_id, event_type", "s.ts, s.user_id, s.event_type", "FROM s"))
    e = events(spark, sf_dir).withColumn("__seq", F.array("event_id"))
    lines = to_json(e.select("ts", F.col("user_id").cast("int").alias("user_id"), "event_type", "__seq"), p.streams["s"])
    done = p.frames({"s": from_json(lines, p.streams["s"])}, lambda q, frames: q.batch(frames))
    return plain(done["out_s"].select("ts", "user_id", "event_type"))


QUERIES = {
    "passthrough": over_events("ts TIMESTAMP NOT NULL ROWTIME, event_id BIGINT NOT NULL, event_type TEXT NOT NULL, value FLOAT NOT NULL", into("ts, event_id, event_type, value", "e.ts, e.event_id, e.event_type, e.value")),
    "projection": over_events("event_id BIGINT NOT NULL, v FLOAT NOT NULL", into("event_id, v", "e.event_id, 32.0 + e.value * 2.0")),
    "insert_reorder": over_events("a BIGINT NOT NULL, b TEXT NOT NULL, c BIGINT NOT NULL", into("c, a, b", "e.user_id, e.event_id, e.event_type")),
    "arith_add": over_events("event_id BIGINT NOT NULL, v BIGINT NOT NULL", into("event_id, v", "e.event_id, e.user_id + e.event_id")),
    "arith_mul": over_events("event_id BIGINT NOT NULL, v BIGINT NOT NULL", into("event_id, v", "e.event_id, e.user_id * 3")),
    "unary_minus": over_events("event_id BIGINT NOT NULL, v BIGINT NOT NULL", into("event_id, v", "e.event_id, -e.user_id + 1")),
    "right_assoc": over_events("event_id BIGINT NOT NULL, v BIGINT NOT NULL", into("event_id, v", "e.event_id, e.user_id * 2 + 3")),
    "eq_null": over_events("event_id BIGINT NOT NULL, a BOOLEAN NOT NULL, b BOOLEAN NOT NULL", into("event_id, a, b", "e.event_id, e.event_type = 'click', e.event_type = NULL")),
    "and_null": over_events("event_id BIGINT NOT NULL, a BOOLEAN NOT NULL, b BOOLEAN NOT NULL", into("event_id, a, b", "e.event_id, TRUE AND e.event_type = 'view', TRUE AND NULL")),
    "float_to_int_ceil": over_events("event_id BIGINT NOT NULL, v INTEGER NOT NULL", into("event_id, v", "e.event_id, e.value")),
    "unsigned_integer": over_events("event_id BIGINT NOT NULL, v UNSIGNED INTEGER NOT NULL", into("event_id, v", "e.event_id, 4294967295")),
    "floor_time_secs": over_events("event_id BIGINT NOT NULL, t TIMESTAMP NOT NULL", into("event_id, t", "e.event_id, FLOOR_TIME(e.ts, DURATION_SECS(90))")),
    "floor_time_millis": over_events("event_id BIGINT NOT NULL, t TIMESTAMP NOT NULL", into("event_id, t", "e.event_id, FLOOR_TIME(e.ts, DURATION_MILLIS(250))")),
    "timestamp_to_text": over_events("event_id BIGINT NOT NULL, t TEXT NOT NULL", into("event_id, t", "e.event_id, e.ts")),
    "fixed_avg_global": over_events("avg_value FLOAT NOT NULL", into("avg_value", "AVG(e.value) AS a", f"FROM e {_FIXED}")),
    "fixed_avg_group1": over_events("ts TIMESTAMP NOT NULL ROWTIME, avg_value FLOAT NOT NULL", into("ts, avg_value", "FLOOR_TIME(e.ts, DURATION_SECS(3600)) AS t, AVG(e.value) AS a", f"FROM e GROUP BY t {_FIXED}")),
    "fixed_avg_group2": over_events(KEYS, into("ts, event_type, avg_value", _SELECT, _GROUP)),
    "aggregate_select_order": over_events(KEYS, into("avg_value, ts, event_type", "AVG(e.value) AS a, FLOOR_TIME(e.ts, DURATION_SECS(3600)) AS t, e.event_type AS k", _GROUP)),
    "sliding_avg": over_events("event_type TEXT NOT NULL, avg_value FLOAT NOT NULL", into("event_type, avg_value", "e.event_type AS k, AVG(e.value) AS a", "FROM e GROUP BY k SLIDING WINDOW DURATION_SECS(7200), DURATION_SECS(1800), DURATION_SECS(60)")),
    "gapped_avg": over_events("event_type TEXT NOT NULL, avg_value FLOAT NOT NULL", into("event_type, avg_value", "e.event_type AS k, AVG(e.value) AS a", "FROM e GROUP BY k SLIDING WINDOW DURATION_SECS(1800), DURATION_SECS(3600), DURATION_SECS(0)")),
    "late_drop_fixed": over_events("event_type TEXT NOT NULL, avg_value FLOAT NOT NULL", into("event_type, avg_value", "e.event_type AS k, AVG(e.value) AS a", "FROM e GROUP BY k FIXED WINDOW DURATION_SECS(3600), DURATION_SECS(3600)"), order=("user_id", "event_id")),
    "late_drop_sliding": over_events("event_type TEXT NOT NULL, avg_value FLOAT NOT NULL", into("event_type, avg_value", "e.event_type AS k, AVG(e.value) AS a", "FROM e GROUP BY k SLIDING WINDOW DURATION_SECS(7200), DURATION_SECS(3600), DURATION_SECS(86400)"), order=("user_id", "event_id")),
    "left_join_fixed": _two("click", "purchase", JOINED, into("ts, event_id, other", "l.ts, l.event_id, r.event_id", f"{JOIN} FIXED WINDOW DURATION_SECS(86400), DURATION_SECS(60)")),
    "left_join_sliding": _two("click", "purchase", JOINED, into("ts, event_id, other", "l.ts, l.event_id, r.event_id", f"{JOIN} SLIDING WINDOW DURATION_SECS(86400), DURATION_SECS(43200), DURATION_SECS(60)")),
    "left_join_theta_bool": _two("click", "purchase", JOINED, into("ts, event_id, other", "l.ts, l.event_id, r.event_id", "FROM l LEFT OUTER JOIN r ON TRUE AND l.user_id = r.user_id FIXED WINDOW DURATION_SECS(86400), DURATION_SECS(60)")),
    "join_then_avg": _two("click", "purchase", "user_id BIGINT NOT NULL, avg_value FLOAT NOT NULL", into("user_id, avg_value", "l.user_id AS u, AVG(l.value) AS a", f"{JOIN} GROUP BY u FIXED WINDOW DURATION_SECS(86400), DURATION_SECS(60)")),
    "fan_out_two_pumps": over_events("event_id BIGINT NOT NULL, v BIGINT NOT NULL", into("event_id, v", "e.event_id, e.user_id + 1"), "CREATE SINK STREAM other_s (event_id BIGINT NOT NULL, v BIGINT NOT NULL);", into("event_id, v", "e.event_id, e.user_id * 10", name="q", target="other_s"), result="other_s"),
    "fan_in_union_all": over_events("v BIGINT NOT NULL", into("v", "m.v", "FROM m", name="last"), "CREATE STREAM m (v BIGINT NOT NULL);", into("v", "e.user_id", name="a", target="m"), into("v", "e.event_id", name="b", target="m")),
    "multi_hop": over_events("ts TIMESTAMP NOT NULL ROWTIME, avg_value FLOAT NOT NULL", into("ts, avg_value", "FLOOR_TIME(m.ts, DURATION_SECS(3600)) AS t, AVG(m.v) AS a", f"FROM m GROUP BY t {_FIXED}"), "CREATE STREAM m (ts TIMESTAMP NOT NULL ROWTIME, v FLOAT NOT NULL);", into("ts, v", "e.ts, e.value", name="first", target="m")),
    "json_roundtrip": push_pop,
    "from_alias": over_events("event_id BIGINT NOT NULL", into("event_id", "x.event_id", "FROM e AS x")),
    "floor_function": over_events("event_id BIGINT NOT NULL, v FLOAT NOT NULL", into("event_id, v", "e.event_id, FLOOR(e.value)")),
    "unsigned_arithmetic": _unsigned,
    "window_without_aggregate": over_events("event_id BIGINT NOT NULL", into("event_id", "e.event_id", f"FROM e {_FIXED}")),
    "literals_and_labels": over_events("event_id BIGINT NOT NULL, a TEXT NOT NULL, b FLOAT NOT NULL, c BOOLEAN NOT NULL, d BIGINT", into("event_id, a, b, c, d", "e.event_id, 'it is', 1.5, TRUE, NULL")),
}

_LATE = sql_avg(HOUR, HOUR, HOUR, "event_type := event_type", order="user_id, event_id")
ORACLES = {
    "passthrough": "SELECT ts, event_id, event_type, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM events",
    "projection": "SELECT event_id, CAST(CAST(32.0 AS FLOAT) + CAST(value AS FLOAT) * CAST(2.0 AS FLOAT) AS DOUBLE) AS v FROM events",
    "insert_reorder": "SELECT event_id AS a, event_type AS b, user_id AS c FROM events",
    "arith_add": "SELECT event_id, user_id + event_id AS v FROM events",
    "arith_mul": "SELECT event_id, user_id * 3 AS v FROM events",
    "unary_minus": "SELECT event_id, -(user_id + 1) AS v FROM events",
    "right_assoc": "SELECT event_id, user_id * (2 + 3) AS v FROM events",
    "eq_null": "SELECT event_id, coalesce(event_type = 'click', false) AS a, false AS b FROM events",
    "and_null": "SELECT event_id, coalesce(event_type = 'view', false) AS a, false AS b FROM events",
    "float_to_int_ceil": "SELECT event_id, CAST(ceil(CAST(value AS FLOAT)) AS INTEGER) AS v FROM events",
    "unsigned_integer": "SELECT event_id, CAST(4294967295 AS BIGINT) AS v FROM events",
    "floor_time_secs": f"SELECT event_id, {sql_floor('ts', 90_000_000)} AS t FROM events",
    "floor_time_millis": f"SELECT event_id, {sql_floor('ts', 250_000)} AS t FROM events",
    "timestamp_to_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '000' AS t FROM events",
    "fixed_avg_global": sql_avg(HOUR, HOUR, 0, ""),
    "fixed_avg_group1": sql_avg(HOUR, HOUR, 0, f"ts := {sql_floor('ts', HOUR)}"),
    "fixed_avg_group2": sql_avg(HOUR, HOUR, 0, f"ts := {sql_floor('ts', HOUR)}, event_type := event_type"),
    "aggregate_select_order": sql_avg(HOUR, HOUR, 0, f"ts := {sql_floor('ts', HOUR)}, event_type := event_type"),
    "sliding_avg": sql_avg(2 * HOUR, HOUR // 2, 60_000_000, "event_type := event_type"),
    "gapped_avg": sql_avg(HOUR // 2, HOUR, 0, "event_type := event_type"),
    "late_drop_fixed": _LATE,
    "late_drop_sliding": sql_avg(2 * HOUR, HOUR, 24 * HOUR, "event_type := event_type", order="user_id, event_id"),
    "left_join_fixed": sql_join(24 * HOUR, 24 * HOUR, 60_000_000) + " SELECT ts, event_id, other FROM joined",
    "left_join_sliding": sql_join(24 * HOUR, 12 * HOUR, 60_000_000) + " SELECT ts, event_id, other FROM joined",
    "left_join_theta_bool": sql_join(24 * HOUR, 24 * HOUR, 60_000_000) + " SELECT ts, event_id, other FROM joined",
    "join_then_avg": sql_join(24 * HOUR, 24 * HOUR, 60_000_000) + ", top AS (SELECT max(epoch_us(ts)) - 60000000 AS w FROM joined) SELECT user_id, CAST(round(avg(CAST(lvalue AS DOUBLE))) AS DOUBLE) AS avg_value FROM joined, top WHERE o + 86400000000 <= w GROUP BY o, user_id",
    "fan_out_two_pumps": "SELECT event_id, user_id * 10 AS v FROM events",
    "fan_in_union_all": "SELECT user_id AS v FROM events UNION ALL SELECT event_id FROM events",
    "multi_hop": sql_avg(HOUR, HOUR, 0, f"ts := {sql_floor('ts', HOUR)}"),
    "json_roundtrip": "SELECT ts, CAST(user_id AS INTEGER) AS user_id, event_type FROM events",
    "from_alias": "SELECT event_id FROM events",
    "floor_function": "SELECT event_id, CAST(floor(CAST(value AS FLOAT)) AS DOUBLE) AS v FROM events",
    "unsigned_arithmetic": "SELECT event_id, user_id * user_id AS a, user_id + user_id AS b FROM events",
    "window_without_aggregate": "SELECT event_id FROM events",
    "literals_and_labels": "SELECT event_id, 'it is' AS a, CAST(1.5 AS DOUBLE) AS b, true AS c, CAST(NULL AS BIGINT) AS d FROM events",
}
