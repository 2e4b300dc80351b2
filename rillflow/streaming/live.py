"""Pumps over streams, with the same rules and the same operators as over stored tables.

One streaming query reads what all readers have landed, in one order of arrival, and hands each micro-batch to the
pumps in the order of the graph. Every stream's part of a micro-batch is computed once, for all the pumps and writers that
read it. A windowed pump keeps its latest row time and the state of its open panes: sums and numbers of values for each
pane and group, or the rows of both sides of a join. The state is a Parquet table in the shared folder that each
micro-batch writes anew by the ordinary operators, so it's dealt over the cluster by pane and key; the number of the micro-batch
names it, so a batch that runs again finds the state from before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import windows
from ..plans.compiler import Plan
from ..plans.parser import Stream
from ..sources.folders import drop_folder, size_of, write_text
from ..sources.rows import from_json, from_typed


class State:
    """Of one window of a pump: the latest row time, and the folder of its open panes."""

    def __init__(self, top: int | None = None, path: str | None = None, rows: int = 0):
        self.top, self.path, self.rows = top, path, rows


def landed(lines: DataFrame) -> DataFrame:
    """Lines of landing files as `__seq`, `__at`, stream, kind and value."""
    parts = F.split("value", "\t", 5)
    return lines.select(F.array(parts[0].cast("bigint")).alias("__seq"), parts[1].cast("bigint").alias("__at"), parts[2].alias("stream"), parts[3].alias("kind"), parts[4].alias("value"))


class Flow:
    """The pipeline's state, and what happens to a micro-batch."""

    def __init__(self, spark: SparkSession, folder: str, streams: dict[str, Stream], frames: Callable, fed: set[str], send: Callable[[dict[str, DataFrame]], None]):
        """frames: as Pipeline.frames; fed: the streams that have readers; send: gets each batch's frames by stream."""
        self.spark, self.folder, self.streams, self.frames, self.fed, self.send = spark, folder, streams, frames, fed, send
        self.states: dict[str, State] = {}
        self.batch = None

    def source(self, rows: DataFrame, name: str) -> DataFrame:
        own, s = rows.filter(F.col("stream") == name), self.streams[name]
        return from_json(own.filter("kind = 'json'"), s).unionByName(from_typed(own.filter("kind = 'typed'"), s))

    def __call__(self, lines: DataFrame, batch: int) -> None:
        """A micro-batch of landed lines."""
        rows = landed(lines).persist()
        try:
            self.take({n: self.source(rows, n) for n in self.fed}, batch)
        finally:
            rows.unpersist()

    def take(self, given: dict[str, DataFrame], batch: int) -> None:
        """A micro-batch of rows of the source streams."""
        self.batch, kept, old = batch, [], []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        try:
            self.send(self.frames({n: keep(df) for n, df in given.items()}, lambda plan, frames: keep(self.step(plan, frames, old))))
            write_text(self.spark, self.folder, f"batch-{batch}.json", json.dumps({k: [s.top, s.path, s.rows] for k, s in self.states.items()}))
            for path in old:
                drop_folder(self.spark, path)
        finally:
            for df in kept:
                df.unpersist()

    def step(self, plan: Plan, frames: dict[str, DataFrame], old: list[str]) -> DataFrame:
        p = plan.pump
        df = frames[p.source[0]]
        if p.join:
            both = plan.joined_rows(df, frames[p.join[0]])
            df = plan.matches(self.advance(f"{p.name}-join", both, plan, lambda live: windows.panes(live, p.window), lambda a, b: a.unionByName(b), old))
        if not plan.aggregates:
            return plan.project(df)

        def add(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.unionByName(b).groupBy("__open", "__close", *plan.key_names()).agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))

        return plan.averages(self.advance(f"{p.name}-average", plan.grouped_rows(df), plan, plan.sums, add, old))

    def advance(self, name: str, rows: DataFrame, plan: Plan, pane: Callable, add: Callable, old: list[str]) -> DataFrame:
        """What the panes that this batch closes hold; the others' state is written. pane: on-time rows into panes; add: state and new panes as one."""
        state = self.states.get(name, State())
        if rows.isEmpty():
            return pane(rows).limit(0)
        live, top = windows.on_time(rows, plan.pump.window.delay, state.top)
        now = pane(live)
        stored = T.StructType([*now.schema.fields, T.StructField("__done", T.BooleanType())])
        if state.path:
            now = add(self.spark.read.schema(stored).parquet(state.path).filter("not __done").drop("__done"), now)
            old.append(state.path)
        path = f"{self.folder}/{name}-{self.batch}"
        now.withColumn("__done", windows.closed(top - plan.pump.window.delay)).write.mode("overwrite").parquet(path)
        both = self.spark.read.schema(stored).parquet(path)
        self.states[name] = State(top, path, both.filter("not __done").count())
        return both.filter("__done").drop("__done")

    def bytes(self) -> dict[str, int]:
        """Of the open panes' state."""
        return {k: size_of(self.spark, s.path) if s.path and s.rows else 0 for k, s in self.states.items()}

    def purge(self) -> None:
        """Open panes go; the watermarks stay."""
        for s in self.states.values():
            if s.path:
                drop_folder(self.spark, s.path)
            s.path, s.rows = None, 0


class Memory:
    """Moderate, Severe and Critical, by the share of a limit that is in use; each is left again at a lower share than it's entered at."""

    def __init__(self, settings: dict):
        self.s, self.state = settings, "Moderate"

    def see(self, used: int) -> str:
        """The state at so many bytes. One step at a time upwards and downwards."""
        share = 100 * used / self.s["upper_limit_bytes"]
        if self.state == "Moderate" and share >= self.s["moderate_to_severe_percent"]:
            self.state = "Severe"
        elif self.state == "Severe" and share >= self.s["severe_to_critical_percent"]:
            self.state = "Critical"
        elif self.state == "Critical" and share <= self.s["critical_to_severe_percent"]:
            self.state = "Severe"
        elif self.state == "Severe" and share <= self.s["severe_to_moderate_percent"]:
            self.state = "Moderate"
        return self.state
