"""Rows at the edge of a pipeline: JSON lines and typed rows, in and out."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidFormat, NullValue, SqlError
from ..functions.types import SPARK, convert, format_timestamp
from ..functions.values import Duration, Timestamp, convert_value, type_of
from ..plans.compiler import with_rowtime
from ..plans.parser import Stream

#: What a JSON value is before it's converted: numbers are FLOAT, times are TEXT.
_JSON = {"TIMESTAMP": "TEXT", "TEXT": "TEXT", "BOOLEAN": "BOOLEAN", "BLOB": "BLOB"}


def _checked(stream: Stream, values: dict[str, tuple[Column, Column]]) -> tuple[list[Column], Column]:
    """The values, and whether they make a row: none is missing or of a wrong type, or NULL in NOT NULL. values: for each column its value (NULL if it
    doesn't convert) and whether the row gave one."""
    out, ok = [], F.lit(True)
    for c in stream.columns:
        v, given = values[c.name]
        ok = ok & (v.isNotNull() | ~given) & (F.lit(True) if c.nullable else v.isNotNull())
        out.append(v.alias(c.name))
    return out, ok


def from_columns(df: DataFrame, stream: Stream, types: dict[str, str]) -> DataFrame:
    """A frame whose columns have these SQL types, and `__seq`. Rows that don't fit are left out, as a source skips them."""
    out, ok = _checked(stream, {c.name: (convert(F.col(f"`{c.name}`"), types[c.name], c.type, lenient=True), F.col(f"`{c.name}`").isNotNull()) for c in stream.columns})
    return with_rowtime(df.filter(ok).select(*out, "__seq"), stream)


def _parsed(lines: DataFrame, stream: Stream, parse: Column, values) -> DataFrame:
    """Lines parsed once each: values(parse) as the stream's columns, without the rows that don't fit. lines has `__seq`, and `__at` (microseconds) if it knows when rows arrived."""
    def row(x: Column) -> Column:
        out, ok = _checked(stream, values(x))
        return F.struct(ok.alias("ok"), F.struct(*out).alias("row"))

    one = F.explode(F.filter(F.transform(F.array(parse), row), lambda r: r["ok"])).alias("r")
    rest = [c for c in lines.columns if c in ("__seq", "__at")]
    return with_rowtime(lines.select(one, *rest).select("r.row.*", *rest), stream)


def from_json(lines: DataFrame, stream: Stream) -> DataFrame:
    """lines: value string, __seq. A row must be a flat JSON object; a number is FLOAT, and so never UNSIGNED; a value of another kind doesn't fit."""
    kinds = {"TEXT": "STRING", "BOOLEAN": "BOOLEAN"}

    def values(j: Column) -> dict:
        out = {}
        for c in stream.columns:
            x, t = F.variant_get(j, f"$.{c.name}", "variant"), _JSON.get(c.type, "FLOAT")
            kind = F.schema_of_variant(x)
            given = x.isNotNull() & (kind != "VOID")
            if t == "BLOB" or c.type.startswith("UNSIGNED"):
                out[c.name] = (F.lit(None).cast(SPARK[c.type]), given)  # no JSON value becomes one
                continue
            own = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") if t == "FLOAT" else kind == kinds[t]
            raw = F.when(own, F.try_variant_get(j, f"$.{c.name}", {"FLOAT": "float", "TEXT": "string", "BOOLEAN": "boolean"}[t]))
            out[c.name] = (convert(raw, t, c.type, lenient=True), given)
        return out

    # most lines can't be nested: only those with brackets inside are looked at as a whole
    whole = F.schema_of_variant(F.try_parse_json("value"))
    flat = F.when(F.col("value").rlike(r"\[|\{.*\{"), ~whole.contains("ARRAY<") & ~F.substring(whole, 2, 1 << 30).contains(" OBJECT<")).otherwise(True)
    return _parsed(lines.filter(F.col("value").rlike(r"^\s*\{") & F.coalesce(flat, F.lit(False))).filter(F.try_parse_json("value").isNotNull()), stream, F.try_parse_json("value"), values)


def from_typed(lines: DataFrame, stream: Stream) -> DataFrame:
    """lines: value string, __seq. Rows of typed values (SourceRow.typed), which keep all their digits."""

    def values(m: Column) -> dict:
        made = {}
        for c in stream.columns:
            x = F.try_element_at(m, F.lit(c.name))
            t, v, out = x["t"], x["v"], F.lit(None).cast(SPARK[c.type])
            for source in ("SMALLINT", "INTEGER", "BIGINT", "UNSIGNED INTEGER", "UNSIGNED BIGINT", "FLOAT", "BOOLEAN", "TEXT", "BLOB", "TIMESTAMP"):
                raw = F.try_to_binary(v, F.lit("base64")) if source == "BLOB" else F.timestamp_micros(v.try_cast("bigint")) if source == "TIMESTAMP" else v.try_cast(SPARK[source])
                try:
                    out = F.when(t == source, convert(raw, source, c.type, lenient=True)).otherwise(out)
                except SqlError:  # this type never becomes that of the column
                    continue
            made[c.name] = (out, F.coalesce(t != "NULL", F.lit(False)))
        return made

    return _parsed(lines, stream, F.from_json("value", "map<string,struct<t:string,v:string>>"), values)


def to_json(df: DataFrame, stream: Stream) -> DataFrame:
    """One JSON object a row (`value`), NULL as null, times as text of nine digits."""
    cols = [format_timestamp(F.col(f"`{c.name}`")).alias(c.name) if c.type == "TIMESTAMP" else F.col(f"`{c.name}`") for c in stream.columns]
    if any(c.type == "BLOB" for c in stream.columns):
        raise SqlError("a BLOB has no JSON form")
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"), "__seq")


class SourceRow:
    """A row to push: values with their SQL types, or a JSON object, whose numbers are FLOAT."""

    def __init__(self, values: dict, types: dict | None = None, as_json: bool = False):
        self.values, self.types, self.as_json = values, types or {k: type_of(v) for k, v in values.items()}, as_json

    @classmethod
    def from_json(cls, text: str) -> SourceRow:
        try:
            values = json.loads(text)
        except ValueError as e:
            raise InvalidFormat(str(e)) from e
        if not isinstance(values, dict) or any(isinstance(v, (dict, list)) for v in values.values()):
            raise InvalidFormat("a flat JSON object expected")
        return cls(values, as_json=True)

    @classmethod
    def from_sink(cls, row: SinkRow) -> SourceRow:
        return cls(dict(zip(row.names, row.values, strict=True)), {n: "NULL" if v is None else t for n, t, v in zip(row.names, row.types, row.values, strict=True)})

    def json(self) -> str:
        return json.dumps(self.values)

    def typed(self) -> str:
        """Names with types and values as text, which from_typed reads."""

        def text(v, t: str) -> str | None:
            if v is None:
                return None
            if t == "BLOB":
                return base64.b64encode(bytes(v)).decode()
            if t == "TIMESTAMP":
                return str((v if isinstance(v, Timestamp) else Timestamp.of(v)).ns // 1000)
            if t == "DURATION":
                return str(v.ns // 1000 if isinstance(v, Duration) else v // dt.timedelta(microseconds=1))
            return str(v).lower() if t == "BOOLEAN" else str(v)

        return json.dumps({k: {"t": self.types[k], "v": text(v, self.types[k])} for k, v in self.values.items()})


class SourceRowBuilder:
    def __init__(self):
        self._values: dict = {}
        self._types: dict = {}

    def add_column(self, name: str, value, type: str | None = None) -> SourceRowBuilder:
        """type: a SQL type, if it shall not be that of the Python value."""
        if name in self._values:
            raise SqlError(f"column {name} twice")
        own = type_of(value)
        self._values[name] = value if type is None or value is None else convert_value(value, own, type)
        self._types[name] = own if type is None or value is None else type
        return self

    def build(self) -> SourceRow:
        return SourceRow(dict(self._values), dict(self._types))


class SinkRow:
    """A row of a sink stream; positions are those of the stream's columns."""

    #: The SQL type that a Python type asks for.
    _ASKED = {str: "TEXT", int: "BIGINT", float: "FLOAT", bool: "BOOLEAN", bytes: "BLOB", Timestamp: "TIMESTAMP", dt.datetime: "TIMESTAMP"}

    def __init__(self, names: list[str], values: list, types: list[str] | None = None):
        self.names, self.values = names, [bytes(v) if isinstance(v, bytearray) else v for v in values]
        self.types = types or [type_of(v) for v in self.values]

    def get_not_null_by_index(self, i: int, kind: type | str | None = None):
        """The value, as a Python type or a SQL type (by name) if one is asked for: integers are checked for their range, FLOAT becomes an integer upwards, a time text of nine digits."""
        if not 0 <= i < len(self.values):
            raise SqlError(f"no column {i}")
        v = self.values[i]
        if v is None:
            raise NullValue(f"column {i} is NULL")
        if kind is None:
            return v
        if kind not in self._ASKED and not isinstance(kind, str):
            raise SqlError(f"no SQL type for {kind}")
        target = kind if isinstance(kind, str) else self._ASKED[kind]
        if kind is int and self.types[i].startswith("UNSIGNED"):
            target = "UNSIGNED BIGINT"
        out = convert_value(v, self.types[i], target.upper())
        return out.datetime() if kind is dt.datetime else out


def parse_time(text: str) -> dt.datetime:
    """`YYYY-MM-DD HH:MM:SS.fffffffff` or RFC 3339, as UTC without zone; beyond microseconds is cut."""
    return Timestamp.parse(text).datetime()
