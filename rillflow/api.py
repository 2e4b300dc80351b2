"""Pipelines: declare streams, pumps, readers and writers, then run them over stored tables or live."""

from __future__ import annotations

import dataclasses
import queue
import time
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InputTimeout, InvalidConfig, SqlError, ThreadPoisoned, Unavailable
from .functions.values import Duration, Timestamp
from .plans.compiler import Plan, with_rowtime
from .plans.parser import Connector, Pump, Stream, parse
from .sources.connectors import Landing, Reader, Reporter, Writer, check
from .sources.folders import drop_folder, new_folder
from .sources.rows import SinkRow, SourceRow, SourceRowBuilder, from_columns, to_json
from .streaming.live import Flow, Memory

#: The settings that files may have, and their defaults.
DEFAULTS = {
    "worker": {"n_generic_worker_threads": 1, "n_source_worker_threads": 1, "sleep_msec_no_row": 100},
    "memory": {
        "upper_limit_bytes": 10_000_000, "moderate_to_severe_percent": 60, "severe_to_critical_percent": 95, "critical_to_severe_percent": 80, "severe_to_moderate_percent": 40,
        "memory_state_transition_interval_msec": 10, "performance_metrics_summary_report_interval_msec": 10,
    },
    "web_console": {"enable_report_post": False, "report_interval_msec": 3_000, "host": "127.0.0.1", "port": 8050, "timeout_msec": 3_000},
    "source_reader": {"net_connect_timeout_msec": 1_000, "net_read_timeout_msec": 100, "can_read_timeout_msec": 100},
    "sink_writer": {"net_connect_timeout_msec": 1_000, "net_write_timeout_msec": 100, "http_connect_timeout_msec": 1_000, "http_timeout_msec": 100},
}


@dataclasses.dataclass(frozen=True)
class Config:
    """Settings, by section and name. worker: `sleep_msec_no_row` is the pause between micro-batches; Spark has its own threads. memory: open panes are purged
    only if a file sets `upper_limit_bytes` (purges)."""

    worker: dict = dataclasses.field(default_factory=lambda: dict(DEFAULTS["worker"]))
    memory: dict = dataclasses.field(default_factory=lambda: dict(DEFAULTS["memory"]))
    web_console: dict = dataclasses.field(default_factory=lambda: dict(DEFAULTS["web_console"]))
    source_reader: dict = dataclasses.field(default_factory=lambda: dict(DEFAULTS["source_reader"]))
    sink_writer: dict = dataclasses.field(default_factory=lambda: dict(DEFAULTS["sink_writer"]))
    purges: bool = False

    @classmethod
    def from_toml(cls, text: str) -> Config:
        try:
            given = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise InvalidConfig(str(e)) from e
        for section, values in given.items():
            if section not in DEFAULTS or not isinstance(values, dict):
                raise InvalidConfig(f"no section {section}")
            for k, v in values.items():
                if k not in DEFAULTS[section]:
                    raise InvalidConfig(f"no setting {section}.{k}")
                if type(v) is not type(DEFAULTS[section][k]) or (isinstance(v, int) and v < 0):
                    raise InvalidConfig(f"{section}.{k} can't be {v!r}")
        return dataclasses.replace(cls(), **{k: DEFAULTS[k] | v for k, v in given.items()}, purges="upper_limit_bytes" in given.get("memory", {}))


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config, self.version = spark, config or Config(), 0
        self.streams: dict[str, Stream] = {}
        self.pumps: dict[str, Plan] = {}
        self.readers: dict[str, Connector] = {}
        self.writers: dict[str, Connector] = {}
        self.inputs: dict[str, queue.Queue] = {}
        self.outputs: dict[str, queue.Queue] = {}
        self._readers: list[Reader] = []
        self._writers: dict[str, Writer] = {}
        self._query = self._flow = self._landing = self._reporter = self._memory = None
        self._began = 0.0
        # times are UTC: that of the whole session
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def command(self, sql: str) -> None:
        """One statement."""
        s = parse(sql)
        if isinstance(s, Stream):
            self._free(s.name)
            names = [c.name for c in s.columns]
            if len(set(names)) != len(names):
                raise SqlError("a column twice")
            times = [c for c in s.columns if c.rowtime]
            if len(times) > 1 or any(c.type != "TIMESTAMP" or c.nullable for c in times):
                raise SqlError("ROWTIME is one TIMESTAMP NOT NULL at most")
            self.streams[s.name] = s
        elif isinstance(s, Pump):
            self._free(s.name)
            plan = Plan(s, self.streams)
            self._acyclic(s)
            self.pumps[s.name] = plan
        else:
            if s.stream not in self.streams:
                raise SqlError(f"no stream {s.stream}")
            check(s)
            own = self.readers if s.kind == "reader" else self.writers
            if s.name in own:
                raise SqlError(f"{s.name} exists")
            if s.type == "IN_MEMORY_QUEUE":
                queues = self.inputs if s.kind == "reader" else self.outputs
                if s.options["NAME"] in queues:
                    raise SqlError(f"queue {s.options['NAME']} exists")
                queues[s.options["NAME"]] = queue.Queue()
            own[s.name] = s
        self.version += 1

    def _free(self, name: str) -> None:
        if name in self.streams or name in self.pumps:
            raise SqlError(f"{name} exists")

    def _acyclic(self, pump: Pump) -> None:
        feeds = lambda p: {p.source[0], *([p.join[0]] if p.join else [])}
        todo, seen = list(feeds(pump)), set()
        while todo:
            s = todo.pop()
            if s == pump.target:
                raise SqlError("streams may not feed themselves")
            if s not in seen:
                seen.add(s)
                todo += [x for q in self.pumps.values() if q.pump.target == s for x in feeds(q.pump)]

    def frames(self, given: dict[str, DataFrame], run) -> dict[str, DataFrame]:
        """All streams' frames, from those of the streams that are fed from outside; several pumps into one stream are its union."""
        done = dict(given)

        def get(name: str) -> DataFrame:
            if name not in done:
                into = [p for p in self.pumps.values() if p.pump.target == name]
                if not into:
                    raise Unavailable(f"nothing feeds {name}")
                parts = []
                for p in into:
                    need = [p.pump.source[0], *([p.pump.join[0]] if p.pump.join else [])]
                    parts.append(run(p, {n: get(n) for n in need}))
                out = parts[0]
                for x in parts[1:]:
                    out = out.unionByName(x)
                done[name] = out
            return done[name]

        for p in self.pumps.values():
            get(p.pump.target)
        return done

    def source(self, name: str, df: DataFrame, order_by: list[str]) -> DataFrame:
        """A stored table as a source stream: its columns must have the declared types or convert to them; order_by gives the arrival order."""
        s = self.streams[name]
        kinds = {"smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "TEXT", "binary": "BLOB", "timestamp": "TIMESTAMP", "timestamp_ntz": "NTZ"}
        types = {k: kinds.get(v, v) for k, v in df.dtypes}
        if missing := [c.name for c in s.columns if c.name not in types]:
            raise SqlError(f"no column {', '.join(missing)} for {name}")
        seq = F.array(*[F.col(f"`{c}`").cast("bigint") for c in order_by]).alias("__seq")
        cols = []
        for c in s.columns:
            v = F.col(f"`{c.name}`")
            if types[c.name] in ("DOUBLE", "NTZ"):
                v, types[c.name] = (v.cast("float"), "FLOAT") if types[c.name] == "DOUBLE" else (v.cast("timestamp"), "TIMESTAMP")
            cols.append(v.alias(c.name))
        return from_columns(df.select(*cols, seq), s, types)

    def run_batch(self, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
        """All pumps over stored tables (frame and arrival order of each source stream): a frame for each stream, with its columns only."""
        done = self.frames({k: self.source(k, df, by) for k, (df, by) in tables.items()}, lambda p, frames: p.batch(frames))
        return {k: df.select(*[f"`{c.name}`" for c in self.streams[k].columns]) for k, df in done.items()}

    def replay(self, tables: dict[str, tuple[DataFrame, str]], batches: int) -> dict[str, DataFrame]:
        """Stored tables through the live engine, in so many micro-batches of equal ranges of arrival numbers: what each stream got, with its columns only.

        tables: frame and the column with the arrival number, by source stream; all streams' numbers are in one order."""
        folder = new_folder(self.spark, "replay")
        given = {n: self.source(n, df, [by]) for n, (df, by) in tables.items()}
        lo, hi = float("inf"), -float("inf")
        for df in given.values():
            r = df.agg(F.min(F.col("__seq")[0]).alias("lo"), F.max(F.col("__seq")[0]).alias("hi")).first()
            if r["lo"] is not None:
                lo, hi = min(lo, r["lo"]), max(hi, r["hi"])
        schemas: dict = {}

        def write(frames: dict[str, DataFrame]) -> None:
            for n, df in frames.items():
                schemas[n] = df.schema
                df.write.mode("append").parquet(f"{folder}/out/{n}")

        flow = Flow(self.spark, folder, self.streams, self.frames, set(given), write)
        if lo > hi:
            lo, hi, batches = 0, 0, 1
        step = -(-(hi - lo + 1) // batches)
        for b in range(batches):
            own = F.col("__seq")[0].between(lo + b * step, lo + (b + 1) * step - 1)
            flow.take({n: df.filter(own) for n, df in given.items()}, b)
        return {n: self.spark.read.schema(schema).parquet(f"{folder}/out/{n}").select(*[f"`{c.name}`" for c in self.streams[n].columns]) for n, schema in schemas.items()}

    def start(self) -> None:
        """Readers, the streaming query and pops begin. A peer that can't be reached is ForeignIo."""
        self.stop()
        folder = new_folder(self.spark, "pipeline")
        self._landing, self._began = Landing(self.spark, f"{folder}/landing"), time.time()
        self._memory, self._folder = Memory(self.config.memory), folder
        try:
            self._writers = {w.name: Writer(w, self.outputs, self.config.sink_writer) for w in self.writers.values()}
            self._readers = [Reader(r, self._landing, self.inputs, self.config.source_reader) for r in self.readers.values()]
        except Exception:
            self.stop()
            raise
        sources = {s.name for s in self.streams.values() if s.kind == "source"} | {r.stream for r in self.readers.values()}
        self._flow = Flow(self.spark, folder, self.streams, self.frames, sources, self._send)
        lines = self.spark.readStream.option("cleanSource", "delete").text(f"{folder}/landing")
        pause = f"{max(1, self.config.worker['sleep_msec_no_row'])} milliseconds"
        self._query = lines.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=pause).start()
        for r in self._readers:
            r.start()
        if self.config.web_console["enable_report_post"]:
            self._reporter = Reporter(self.metrics, self.config.web_console)
            self._reporter.start()

    def _batch(self, lines: DataFrame, number: int) -> None:
        self._flow(lines, number)
        if self.config.purges:
            used = sum(self._flow.bytes().values())
            for _ in range(2):
                self._memory.see(used)
            if self._memory.state == "Critical":
                self._flow.purge()

    def _send(self, frames: dict[str, DataFrame]) -> None:
        for writer in self._writers.values():
            s = self.streams[writer.c.stream]
            if s.name not in frames:
                continue
            out, names = frames[s.name].orderBy("__seq"), [c.name for c in s.columns]
            if writer.c.type == "NET_CLIENT":
                rows = (r[0] for r in to_json(out, s).select("value").toLocalIterator())
            else:
                rows = (list(r) for r in out.select(*[f"`{n}`" for n in names]).toLocalIterator())
            writer.send(rows, names, [c.type for c in s.columns])

    def stop(self) -> None:
        """Ends readers and the query; open panes are lost, as are rows that no micro-batch has taken."""
        for r in (*self._readers, *([self._reporter] if self._reporter else [])):
            r.ending.set()
        for r in self._readers:
            if r.is_alive():
                r.join(5)
            elif r.socket is not None:
                r.socket.close()
        if self._query is not None:
            self._query.stop()
        for w in self._writers.values():
            w.close()
        if self._landing is not None:
            drop_folder(self.spark, self._folder)
        self._readers, self._writers, self._query, self._landing, self._reporter = [], {}, None, None, None

    def _alive(self) -> None:
        for r in self._readers:
            if r.error is not None:
                raise r.error
        if self._query is not None and (e := self._query.exception()) is not None:
            raise ThreadPoisoned("the pipeline's query has ended") from e

    def metrics(self) -> dict:
        """Tasks with their gain in bytes a second since the start (what they land, keep in open panes or send away), and queues with what waits in them."""
        seconds = max(time.time() - self._began, 1e-3)
        landed = dict(self._landing.bytes) if self._landing else {}
        kept = self._flow.bytes() if self._flow and self._query else {}
        rate = lambda n: n / seconds
        tasks = [{"id": r.name, "type": "source-task", "avg-gain-bytes-per-sec": rate(landed.get(r.stream, 0))} for r in self.readers.values()]
        tasks += [{"id": n, "type": "pump-task", "avg-gain-bytes-per-sec": rate(sum(kept.get(f"{n}-{k}", 0) for k in ("join", "average")))} for n in self.pumps]
        tasks += [{"id": n, "type": "sink-task", "avg-gain-bytes-per-sec": -rate(self._writers[n].bytes if n in self._writers else 0)} for n in self.writers]
        feeds: dict[str, list[str]] = {}
        for r in self.readers.values():
            feeds.setdefault(r.stream, []).append(r.name)
        for n, p in self.pumps.items():
            feeds.setdefault(p.pump.target, []).append(n)
        queues, states = [], self._flow.states if self._flow else {}
        for n, p in self.pumps.items():
            for stream in (p.pump.source[0], *([p.pump.join[0]] if p.pump.join else [])):
                own = {"id": f"{stream}-{n}", "upstream-task-id": feeds.get(stream, [""])[0], "downstream-task-id": n}
                waiting = [(states[k].rows, kept.get(k, 0)) for k in (f"{n}-join", f"{n}-average") if k in states]
                if p.pump.window is not None:
                    queues.append(own | {"window-queue": {"num-rows-waiting": sum(x for x, _ in waiting), "total-bytes": sum(x for _, x in waiting)}})
                else:  # each micro-batch takes all rows there are
                    queues.append(own | {"row-queue": {"num-rows": 0, "total-bytes": 0}})
        for w in self.writers.values():
            q = self.outputs.get(w.options.get("NAME", "")) if w.type == "IN_MEMORY_QUEUE" else None
            rows = list(q.queue) if q else []
            queues.append({"id": f"{w.stream}-{w.name}", "upstream-task-id": feeds.get(w.stream, [""])[0], "downstream-task-id": w.name, "row-queue": {"num-rows": len(rows), "total-bytes": sum(len(str(v)) for r in rows for v in r[1])}})
        return {"tasks": tasks, "queues": queues}

    def push(self, name: str, row: SourceRow) -> None:
        if name not in self.inputs:
            raise Unavailable(f"no queue {name}")
        self._alive()
        self.inputs[name].put(row)

    def pop_non_blocking(self, name: str) -> SinkRow | None:
        if name not in self.outputs:
            raise Unavailable(f"no queue {name}")
        try:
            return SinkRow(*self.outputs[name].get_nowait())
        except queue.Empty:
            self._alive()
            return None

    def pop(self, name: str, timeout: float = 30) -> SinkRow:
        end = time.time() + timeout
        while True:
            row = self.pop_non_blocking(name)
            if row is not None:
                return row
            if time.time() > end:
                raise InputTimeout(f"nothing in {name} for {timeout} s")
            time.sleep(0.01)


__all__ = ["Config", "Duration", "Pipeline", "SinkRow", "SourceRow", "SourceRowBuilder", "Timestamp", "with_rowtime"]
