"""Value types at the edges of a pipeline: times of nanoseconds, durations, and how typed values become one another.

Inside Spark times have microseconds, so a time that goes through a pipeline loses what is below them.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
from dataclasses import dataclass

from ..errors import SqlError, TimeError

_EPOCH = dt.datetime(1970, 1, 1)
_TIME = re.compile(r"(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)?")


@dataclass(frozen=True, order=True)
class Duration:
    """Not negative; nanoseconds."""

    ns: int

    def __post_init__(self):
        if self.ns < 0:
            raise TimeError("a duration can't be negative")

    @classmethod
    def secs(cls, n: int) -> Duration:
        return cls(n * 1_000_000_000)

    @classmethod
    def millis(cls, n: int) -> Duration:
        return cls(n * 1_000_000)


@dataclass(frozen=True, order=True)
class Timestamp:
    """Nanoseconds since 1970-01-01 00:00 UTC."""

    ns: int

    @classmethod
    def parse(cls, text: str) -> Timestamp:
        """`YYYY-MM-DD HH:MM:SS.fffffffff` or RFC 3339 with its offset."""
        m = _TIME.fullmatch(text)
        if not m:
            raise TimeError(f"not a time: {text!r}")
        try:
            t = dt.datetime.fromisoformat(f"{m[1]}T{m[2]}{'+00:00' if m[4] in (None, 'Z') else m[4]}")
        except ValueError as e:
            raise TimeError(f"not a time: {text!r}") from e
        whole = t.astimezone(dt.UTC).replace(tzinfo=None) - _EPOCH
        return cls((whole.days * 86_400 + whole.seconds) * 1_000_000_000 + int((m[3] or "0").ljust(9, "0")))

    @classmethod
    def of(cls, t: dt.datetime) -> Timestamp:
        """A time without zone is UTC."""
        d = (t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t) - _EPOCH
        return cls(((d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds) * 1000)

    def floor(self, d: Duration) -> Timestamp:
        return Timestamp(self.ns - self.ns % d.ns)

    def ceil(self, d: Duration) -> Timestamp:
        return Timestamp(-(-self.ns // d.ns) * d.ns)

    def __add__(self, d: Duration) -> Timestamp:
        return Timestamp(self.ns + d.ns)

    def datetime(self) -> dt.datetime:
        """UTC without zone; what is below microseconds is cut."""
        return _EPOCH + dt.timedelta(microseconds=self.ns // 1000)

    def __str__(self) -> str:
        return f"{_EPOCH + dt.timedelta(seconds=self.ns // 1_000_000_000):%Y-%m-%d %H:%M:%S}.{self.ns % 1_000_000_000:09d}"


BOUNDS = {
    "SMALLINT": (-(1 << 15), (1 << 15) - 1), "INTEGER": (-(1 << 31), (1 << 31) - 1), "BIGINT": (-(1 << 63), (1 << 63) - 1),
    "UNSIGNED INTEGER": (0, (1 << 32) - 1), "UNSIGNED BIGINT": (0, (1 << 64) - 1),
}


def type_of(v) -> str:
    """The SQL type that a Python value stands for."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "BOOLEAN"
    if isinstance(v, int):
        return "BIGINT" if v < 1 << 63 else "UNSIGNED BIGINT"
    for kind, name in ((float, "FLOAT"), (str, "TEXT"), ((bytes, bytearray), "BLOB"), ((Timestamp, dt.datetime), "TIMESTAMP"), ((Duration, dt.timedelta), "DURATION")):
        if isinstance(v, kind):
            return name
    raise SqlError(f"no SQL type for {type(v).__name__}")


def single(v: float) -> float:
    """As FLOAT has it."""
    return struct.unpack("f", struct.pack("f", v))[0]


def convert_value(v, source: str, target: str):
    """A value of one type as another, by the rules for columns; SqlError if it can't be."""
    signed, unsigned = source in ("SMALLINT", "INTEGER", "BIGINT"), source.startswith("UNSIGNED")
    if target in BOUNDS and (signed or (unsigned and target.startswith("UNSIGNED"))):
        lo, hi = BOUNDS[target]
        if not lo <= v <= hi:
            raise SqlError(f"{v} is out of range for {target}")
        return int(v)
    if target in BOUNDS and source == "FLOAT" and not target.startswith("UNSIGNED"):
        lo, hi = BOUNDS[target]
        return 0 if math.isnan(v) else lo if v <= lo else hi if v > hi - 1 else math.ceil(v)  # upwards, saturating
    if target == "FLOAT" and (signed or source == "FLOAT"):
        return single(v)
    if target == "TIMESTAMP" and source in ("TIMESTAMP", "TEXT"):
        return Timestamp.parse(v) if source == "TEXT" else v if isinstance(v, Timestamp) else Timestamp.of(v)
    if target == "TEXT" and source == "TIMESTAMP":
        return str(v if isinstance(v, Timestamp) else Timestamp.of(v))
    if source == target:
        return bytes(v) if source == "BLOB" else v
    raise SqlError(f"{source} can't be converted to {target}")
