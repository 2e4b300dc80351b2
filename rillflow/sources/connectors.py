"""Readers feed a stream from outside; writers send a sink stream's rows out.

A reader runs in a thread of the driver and lands its rows as small files, which the pipeline's streaming query reads
in order of arrival; all readers of a pipeline count arrivals together. A writer gets each micro-batch in order,
row by row through an iterator. A peer that can't be reached is an error when the pipeline starts; an error later ends
the reader, and the pipeline's next pop or push raises it.
"""

from __future__ import annotations

import json
import queue
import socket
import struct
import threading
import time
import urllib.error
import urllib.request

from pyspark.sql import SparkSession

from ..errors import ForeignIo, InvalidOption, PipelineError
from ..plans.parser import Connector
from .folders import write_text
from .rows import SourceRow

READERS, WRITERS = ("NET_CLIENT", "NET_SERVER", "CAN", "IN_MEMORY_QUEUE"), ("NET_CLIENT", "HTTP1_CLIENT", "IN_MEMORY_QUEUE")


def option(c: Connector, key: str, default: str | None = None) -> str:
    value = c.options.get(key, default)
    if value is None:
        raise InvalidOption(f"{c.name} needs {key}")
    return value


def port(c: Connector, key: str) -> int:
    try:
        n = int(option(c, key))
    except ValueError as e:
        raise InvalidOption(f"{key} isn't a port") from e
    if not 0 <= n < 65536:
        raise InvalidOption(f"{key} isn't a port")
    return n


def check(c: Connector) -> None:
    """Options of a reader or writer, before it starts."""
    known = READERS if c.kind == "reader" else WRITERS
    if c.type not in known:
        raise InvalidOption(f"no {c.kind} type {c.type}")
    if c.type in ("NET_CLIENT", "NET_SERVER") and option(c, "PROTOCOL", "TCP") != "TCP":
        raise InvalidOption("PROTOCOL can be TCP only")
    if c.type in ("NET_CLIENT", "HTTP1_CLIENT"):
        option(c, "REMOTE_HOST"), port(c, "REMOTE_PORT")
    if c.type == "NET_SERVER":
        port(c, "PORT")
    if c.type == "HTTP1_CLIENT":
        option(c, "BLOB_BODY_COLUMN"), option(c, "URL", "/")
        if option(c, "METHOD", "POST") != "POST":
            raise InvalidOption("METHOD can be POST only")
    if c.type == "IN_MEMORY_QUEUE":
        option(c, "NAME")
    if c.type == "CAN":
        option(c, "INTERFACE")


def can_row(frame: bytes) -> SourceRow:
    """A frame as it comes from the socket: can_id UNSIGNED INTEGER and can_data BLOB. Error frames are errors, extended and remote ones aren't supported."""
    can_id, size = struct.unpack("=IB3x", frame[:8])
    if can_id & 0x20000000:
        raise ForeignIo(f"an error frame, CAN id {can_id & 0x1FFFFFFF}")
    if can_id & 0xC0000000:
        raise ForeignIo("extended and remote frames aren't supported")
    return SourceRow({"can_id": can_id, "can_data": frame[8 : 8 + size]}, {"can_id": "UNSIGNED INTEGER", "can_data": "BLOB"})


class Landing:
    """A folder of numbered files: arrival number and time (microseconds), stream, `json` or `typed`, and the row, one row a line."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.n, self.files, self.bytes, self.lock = spark, folder, 0, 0, {}, threading.Lock()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def put(self, stream: str, rows: list[str | SourceRow]) -> None:
        """JSON texts, or rows."""
        if not rows:
            return
        with self.lock:
            lines = []
            for r in rows:
                kind, text = ("json", r.strip().replace("\n", " ")) if isinstance(r, str) else ("json", r.json()) if r.as_json else ("typed", r.typed())
                lines.append(f"{self.n}\t{time.time_ns() // 1000}\t{stream}\t{kind}\t{text}\n")
                self.n += 1
            text = "".join(lines)
            write_text(self.spark, self.folder, f"{self.files:012d}.txt", text)
            self.files += 1
            self.bytes[stream] = self.bytes.get(stream, 0) + len(text)


class Reader(threading.Thread):
    """Until stopped, takes rows from its source and lands them. settings: of the section source_reader."""

    def __init__(self, c: Connector, landing: Landing, queues: dict[str, queue.Queue], settings: dict):
        super().__init__(daemon=True)
        self.c, self.landing, self.queues, self.ending = c, landing, queues, threading.Event()
        self.error: Exception | None = None
        self.pause = settings["can_read_timeout_msec" if c.type == "CAN" else "net_read_timeout_msec"] / 1000
        try:
            if c.type == "NET_SERVER":
                self.socket = socket.create_server(("127.0.0.1", port(c, "PORT")))
            elif c.type == "NET_CLIENT":
                self.socket = socket.create_connection((option(c, "REMOTE_HOST"), port(c, "REMOTE_PORT")), timeout=settings["net_connect_timeout_msec"] / 1000)
            elif c.type == "CAN":
                self.socket = socket.socket(socket.AF_CAN, socket.SOCK_RAW, socket.CAN_RAW)
                self.socket.bind((option(c, "INTERFACE"),))
            else:
                self.socket = None
        except OSError as e:
            raise ForeignIo(f"{c.name} can't open its {c.type} source: {e}") from e
        if self.socket is not None:
            self.socket.settimeout(self.pause)

    def run(self) -> None:
        try:
            {"NET_CLIENT": lambda: self.lines(self.socket), "NET_SERVER": self.serve, "CAN": self.can, "IN_MEMORY_QUEUE": self.drain}[self.c.type]()
        except Exception as e:  # noqa: BLE001
            if not self.ending.is_set():
                self.error = e if isinstance(e, PipelineError) else ForeignIo(f"{self.c.name}: {e}")
        finally:
            if self.socket is not None:
                self.socket.close()

    def drain(self) -> None:
        q = self.queues[option(self.c, "NAME")]
        while not self.ending.is_set():
            rows = []
            try:
                rows.append(q.get(timeout=self.pause))
                while len(rows) < 10_000:
                    rows.append(q.get_nowait())
            except queue.Empty:
                pass
            self.landing.put(self.c.stream, rows)

    def lines(self, s: socket.socket) -> None:
        s.settimeout(self.pause)
        left = b""
        while not self.ending.is_set():
            try:
                got = s.recv(1 << 16)
            except TimeoutError:  # no row for now
                continue
            if not got:
                break
            *whole, left = (left + got).split(b"\n")
            self.landing.put(self.c.stream, [x.decode("utf-8", "replace") for x in whole if x.strip()])
        if left.strip():
            self.landing.put(self.c.stream, [left.decode("utf-8", "replace")])

    def serve(self) -> None:
        while not self.ending.is_set():
            try:
                s, _ = self.socket.accept()
            except TimeoutError:
                continue
            with s:
                self.lines(s)

    def can(self) -> None:
        while not self.ending.is_set():
            try:
                frame = self.socket.recv(16)
            except TimeoutError:
                continue
            self.landing.put(self.c.stream, [can_row(frame)])


class Writer:
    """settings: of the section sink_writer."""

    def __init__(self, c: Connector, queues: dict[str, queue.Queue], settings: dict):
        self.c, self.queues, self.settings, self.socket, self.bytes, self.rows = c, queues, settings, None, 0, 0
        if c.type == "NET_CLIENT":
            try:
                self.socket = socket.create_connection((option(c, "REMOTE_HOST"), port(c, "REMOTE_PORT")), timeout=settings["net_connect_timeout_msec"] / 1000)
                self.socket.settimeout(settings["net_write_timeout_msec"] / 1000)
            except OSError as e:
                raise ForeignIo(f"{c.name} can't reach its peer: {e}") from e

    def send(self, rows, names: list[str], types: list[str]) -> None:
        """rows: values, or JSON texts for NET_CLIENT."""
        for values in rows:
            try:
                self.rows += 1
                if self.c.type == "IN_MEMORY_QUEUE":
                    self.bytes += sum(len(str(v)) for v in values)
                    self.queues[option(self.c, "NAME")].put((names, values, types))
                elif self.c.type == "NET_CLIENT":
                    data = values.encode() + b"\n"
                    self.socket.sendall(data)
                    self.bytes += len(data)
                else:
                    self.post(values[names.index(option(self.c, "BLOB_BODY_COLUMN"))])
            except (OSError, urllib.error.URLError) as e:
                raise ForeignIo(f"{self.c.name}: {e}") from e

    def post(self, body) -> None:
        if body is None:
            raise ForeignIo(f"{self.c.name}: a body can't be NULL")
        url = option(self.c, "URL", "/")
        if not url.startswith("http://"):
            url = f"http://{option(self.c, 'REMOTE_HOST')}:{port(self.c, 'REMOTE_PORT')}{url}"
        headers = {k.removeprefix("HEADER_"): v for k, v in self.c.options.items() if k.startswith("HEADER_")}
        urllib.request.urlopen(urllib.request.Request(url, data=bytes(body), headers=headers, method="POST"), timeout=self.settings["http_timeout_msec"] / 1000).close()
        self.bytes += len(body)

    def close(self) -> None:
        if self.socket is not None:
            self.socket.close()


class Reporter(threading.Thread):
    """Posts the pipeline's metrics to a web console, again and again; a console that doesn't answer is asked again later. settings: of the section web_console."""

    def __init__(self, metrics, settings: dict):
        super().__init__(daemon=True)
        self.metrics, self.settings, self.ending = metrics, settings, threading.Event()

    def run(self) -> None:
        url = f"http://{self.settings['host']}:{self.settings['port']}/task-graph"
        while not self.ending.wait(self.settings["report_interval_msec"] / 1000):
            try:
                data = json.dumps(self.metrics()).encode()
                urllib.request.urlopen(urllib.request.Request(url, data=data, headers={"Content-Type": "application/json"}, method="POST"), timeout=self.settings["timeout_msec"] / 1000).close()
            except OSError:
                time.sleep(0)


__all__ = ["Landing", "Reader", "Reporter", "Writer", "can_row", "check"]
