"""Pumps as functions from stream frames to stream frames, for stored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SqlError
from ..functions.expressions import as_predicate, compile_expression
from ..functions.types import SIGNED, SPARK, convert
from ..operators import windows
from ..sources.folders import table
from .parser import Avg, Col, Name, Pump, Stream


def scope(streams: dict[str, tuple[Stream, Callable[[str], Column]]], order: list[str]):
    """Resolves stream.column by the names that FROM gave. `ptime` is the arrival time of streams without ROWTIME."""

    def find(c: Col) -> tuple[Column, str]:
        if c.stream not in streams:
            raise SqlError(f"no stream {c.stream} in FROM")
        stream, get = streams[c.stream]
        own = next((x for x in stream.columns if x.name == c.name), None)
        if own is not None:
            return get(c.name), own.type
        if c.name.lower() == "ptime":
            first, get = streams[order[0]]
            if first.rowtime:
                raise SqlError(f"{order[0]} has a ROWTIME and so no ptime")
            return F.timestamp_micros(F.col("__rt")), "TIMESTAMP"
        raise SqlError(f"no column {c.name} in {c.stream}")

    return find


class Plan:
    """A pump after analysis."""

    def __init__(self, pump: Pump, streams: dict[str, Stream]):
        for name in (pump.target, pump.source[0], *([pump.join[0]] if pump.join else [])):
            if name not in streams:
                raise SqlError(f"no stream {name}")
        self.pump, self.target, self.source = pump, streams[pump.target], streams[pump.source[0]]
        self.right = streams[pump.join[0]] if pump.join else None
        if self.right is not None and pump.join[1] == pump.source[1]:
            raise SqlError("both sides of a join have one name; give them aliases")
        columns = {c.name: c for c in self.target.columns}
        if len(set(pump.columns)) != len(pump.columns) or set(pump.columns) - set(columns):
            raise SqlError(f"INSERT INTO names columns twice or that {pump.target} hasn't")
        if len(pump.columns) != len(pump.select):
            raise SqlError(f"{len(pump.select)} values for {len(pump.columns)} columns")
        if missing := [c.name for c in self.target.columns if c.name not in pump.columns]:
            raise SqlError(f"no values for {', '.join(missing)}")
        self.aggregates = [e for e, _ in pump.select if isinstance(e, Avg)]
        if len(self.aggregates) > 1:
            raise SqlError("one AVG at most")
        if (self.aggregates or pump.join) and pump.window is None:
            raise SqlError("AVG and JOIN need a window")
        sides = {pump.source[1]: (self.source, self.getter(0))} | ({pump.join[1]: (self.right, self.getter(1))} if pump.join else {})
        self.scope = scope(sides, list(sides))
        alias = {a: e for e, a in pump.select if a and not isinstance(e, Avg)}
        self.keys = []
        for g in pump.group:
            if isinstance(g, Name) and g.name not in alias:
                raise SqlError(f"no alias {g.name}")
            self.keys.append(alias[g.name] if isinstance(g, Name) else g)
        if self.aggregates:
            for e, _ in pump.select:
                if not isinstance(e, Avg) and e not in self.keys:
                    raise SqlError("what is selected beside AVG must be grouped by")
            t = compile_expression(self.aggregates[0].of, self.scope)[1]
            if t not in (*SIGNED, "FLOAT"):
                raise SqlError(f"AVG({t})")
        self.types = [("FLOAT" if isinstance(e, Avg) else compile_expression(e, self.scope)[1]) for e, _ in pump.select]
        for name, t in zip(pump.columns, self.types, strict=True):
            convert(F.lit(None), t, columns[name].type)
        if pump.join:
            as_predicate(pump.join[2], self.scope)

    def getter(self, side: int) -> Callable[[str], Column]:
        joined = self.right is not None
        return lambda name: F.col(f"{'lr'[side]}.`{name}`") if joined else F.col(f"`{name}`")

    def insert(self, df: DataFrame, values: list[Column]) -> DataFrame:
        """Values of the select list into the target's columns, with its row time and the arrival order."""
        by = dict(zip(self.pump.columns, zip(values, self.types, strict=True), strict=True))
        out = []
        for c in self.target.columns:
            v, t = by[c.name]
            v = convert(v, t, c.type)
            if not c.nullable:
                v = F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"NULL into {c.name}")).cast(SPARK[c.type]))
            out.append(v.alias(c.name))
        df = df.select(*out, "__seq")
        return with_rowtime(df, self.target)

    def grouped_rows(self, df: DataFrame) -> DataFrame:
        """`__rt`, `__seq`, the keys and the value to average."""
        keys = [compile_expression(e, self.scope)[0].alias(f"__k{i}") for i, e in enumerate(self.keys)]
        return df.select("__rt", "__seq", *keys, compile_expression(self.aggregates[0].of, self.scope)[0].cast("double").alias("__v"))

    def sums(self, live: DataFrame) -> DataFrame:
        """Of each pane and group the sum and number of its values: all that a pane needs to keep."""
        return windows.panes(live, self.pump.window).groupBy("__open", "__close", *self.key_names()).agg(F.sum("__v").alias("__sum"), F.count("__v").alias("__n"))

    def key_names(self) -> list[str]:
        return [f"__k{i}" for i in range(len(self.keys))]

    def averages(self, done: DataFrame) -> DataFrame:
        """Rows of the target from the sums of closed panes."""
        out = done.withColumn("__avg", windows.rounded_average(F.col("__sum"), F.col("__n"))).withColumn("__rt", F.col("__open")).withColumn("__seq", F.array("__close"))
        return self.insert(out, [F.col("__avg") if isinstance(e, Avg) else F.col(f"__k{self.keys.index(e)}") for e, _ in self.pump.select])

    def joined_rows(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of both sides, as structs l and r, in one arrival order: where numbers are equal, left first."""
        cols, sides = ("l", "r"), []
        for i, (df, s) in enumerate(((left, self.source), (right, self.right))):
            own = F.struct(*[F.col(f"`{c.name}`") for c in s.columns]).alias(cols[i])
            other = F.lit(None).cast((right if i == 0 else left).select(F.struct(*[F.col(f"`{c.name}`") for c in (self.right if i == 0 else self.source).columns]).alias("x")).schema["x"].dataType).alias(cols[1 - i])
            sides.append(df.select(F.lit(i).alias("__side"), F.concat("__seq", F.array(F.lit(i).cast("bigint"))).alias("__seq"), "__rt", *([own, other] if i == 0 else [other, own])))
        return sides[0].unionByName(sides[1])

    def matches(self, done: DataFrame) -> DataFrame:
        """The rows of closed panes joined; in order of closing, left and right arrival."""
        a = done.filter("__side = 0").select("l", "__rt", "__seq", "__open", "__close")
        b = done.filter("__side = 1").select("r", F.col("__seq").alias("__rseq"), F.col("__open").alias("__ropen"))
        out = a.join(b, (F.col("__open") == F.col("__ropen")) & as_predicate(self.pump.join[2], self.scope), "left")
        seq = F.concat(F.array("__close"), F.col("__seq"), F.coalesce("__rseq", F.array().cast("array<bigint>")))
        return out.select("l", "r", "__rt", seq.alias("__seq"))

    def project(self, df: DataFrame) -> DataFrame:
        return self.insert(df, [compile_expression(e, self.scope)[0] for e, _ in self.pump.select])

    def batch(self, frames: dict[str, DataFrame]) -> DataFrame:
        """Over all rows there are; panes that the last watermark hasn't closed stay open and give nothing."""
        p, w = self.pump, self.pump.window
        df = frames[p.source[0]]
        if p.join:
            live, top = windows.on_time(self.joined_rows(df, frames[p.join[0]]), w.delay)
            df = self.matches(windows.panes(live, w).filter(windows.closed(None if top is None else top - w.delay)))
        if not self.aggregates:
            return self.project(df)
        rows = self.grouped_rows(df)
        if p.join:  # read twice below, so the join runs once
            rows = table(rows, "joined")
        live, top = windows.on_time(rows, w.delay)
        return self.averages(self.sums(live).filter(windows.closed(None if top is None else top - w.delay)))


def with_rowtime(df: DataFrame, stream: Stream) -> DataFrame:
    """__rt from the ROWTIME column, or from the arrival time: `__at` where the reader gave one, else now."""
    rt = F.unix_micros(F.col(f"`{stream.rowtime}`")) if stream.rowtime else F.col("__at") if "__at" in df.columns else F.unix_micros(F.current_timestamp())
    return df.withColumn("__rt", rt).drop("__at")
