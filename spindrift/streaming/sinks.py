"""Sinks of micro-batches, by URI: stdout:, memory:, file:PATH, udp/tcp (syslog), http(s), kafka:.

A sink is called with a batch's DataFrame of JSON lines (`value`) and an epoch; what it
sends goes out from the executors, but for stdout and memory, which keep a bounded tail."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSLOG_PORT, TAIL = 514, 200


class Sink:
    delivered = 0
    failed = 0

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        raise NotImplementedError


class Stdout(Sink):
    def __call__(self, batch, epoch):
        for r in batch.toLocalIterator():
            print(r.value, flush=True)


class Memory(Sink):
    """The last rows of all."""

    def __init__(self, most: int = TAIL):
        self.rows: deque = deque(maxlen=most)

    def __call__(self, batch, epoch):
        self.rows.extend(json.loads(r.value) for r in batch.toLocalIterator())


class Files(Sink):
    """JSON lines, one directory for each epoch; a replayed epoch overwrites its own; only the last `keep` stay if given."""

    def __init__(self, path: str, keep: int | None = None):
        self.path, self.keep, self.epochs = path, keep, deque()

    def __call__(self, batch, epoch):
        to = f"{self.path}/epoch={epoch:012d}"
        batch.select("value").write.mode("overwrite").text(to)
        self.epochs.append(to)
        if self.keep and len(self.epochs) > self.keep:
            old = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(self.epochs.popleft())
            old.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def syslog_line(body: str, host: str = "spindrift", app: str = "spindrift", rfc: int = 5424, priority: int = 134, now: str = "-") -> str:
    return f"<{priority}>1 {now} {host} {app} - - - {body}" if rfc == 5424 else f"<{priority}>{now} {host} {app}: {body}"


class Syslog(Sink):
    """UDP datagrams, or TCP with octet counts."""

    def __init__(self, host: str, port: int = SYSLOG_PORT, tcp: bool = False, rfc: int = 5424):
        self.host, self.port, self.tcp, self.rfc = host, port, tcp, rfc

    def __call__(self, batch, epoch):
        host, port, tcp, rfc = self.host, self.port, self.tcp, self.rfc

        def send(rows: Iterator) -> None:
            import datetime as dt
            import socket

            with socket.socket(socket.AF_INET, socket.SOCK_STREAM if tcp else socket.SOCK_DGRAM) as s:
                if tcp:
                    s.connect((host, port))
                for r in rows:
                    now = dt.datetime.now(dt.timezone.utc)
                    stamp = now.isoformat(timespec="milliseconds").replace("+00:00", "Z") if rfc == 5424 else now.strftime("%b %e %H:%M:%S")
                    line = syslog_line(r.value, rfc=rfc, now=stamp).encode()
                    s.sendall(f"{len(line)} ".encode() + line) if tcp else s.sendto(line, (host, port))

        batch.foreachPartition(send)


class Http(Sink):
    """Posts of ndjson, of arrays, or of single records."""

    def __init__(self, url: str, form: str = "ndjson", most: int = 500, timeout: float = 10):
        if form not in ("ndjson", "array", "single"):
            raise ValueError(f"unknown body form {form!r}")
        self.url, self.form, self.most, self.timeout = url, form, most, timeout

    def __call__(self, batch, epoch):
        url, form, most, timeout = self.url, self.form, self.most, self.timeout

        def send(rows: Iterator) -> None:
            import urllib.request

            def post(lines: list[str]) -> None:
                body = "\n".join(lines) + "\n" if form == "ndjson" else "[" + ",".join(lines) + "]" if form == "array" else lines[0]
                kind = "application/x-ndjson" if form == "ndjson" else "application/json"
                urllib.request.urlopen(urllib.request.Request(url, body.encode(), {"Content-Type": kind}), timeout=timeout).close()

            held: list[str] = []
            for r in rows:
                held.append(r.value)
                if len(held) >= (1 if form == "single" else most):
                    post(held)
                    held = []
            if held:
                post(held)

        batch.foreachPartition(send)


class Kafka(Sink):
    """Spark's own Kafka writer; its connector must be on the class path."""

    def __init__(self, servers: str, topic: str, key_field: str | None = None, acks: str = "all", compression: str = "lz4"):
        self.options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": acks, "kafka.compression.type": compression}
        self.key_field = key_field

    def __call__(self, batch, epoch):
        out = batch.withColumn("key", F.get_json_object("value", f"$.{self.key_field}")) if self.key_field else batch
        out.write.format("kafka").options(**self.options).save()


def of(uri: str) -> Sink:
    u = urlparse(uri)
    q = {k: v[0] for k, v in parse_qs(u.query).items()}
    if uri in ("-", "stdout", "stdout:", "stdout://"):
        return Stdout()
    if u.scheme == "memory" or uri == "memory":
        return Memory(int(q.get("keep", TAIL)))
    if u.scheme in ("udp", "tcp", "syslog", "syslog+udp", "syslog+tcp"):
        return Syslog(u.hostname or "127.0.0.1", u.port or SYSLOG_PORT, "tcp" in u.scheme, int(q.get("rfc", 5424)))
    if u.scheme in ("http", "https"):
        form = q.get("body", "ndjson")
        return Http(uri.split("?")[0] if "body" in q else uri, form)
    if u.scheme == "kafka":
        return Kafka(u.netloc, u.path.strip("/"), q.get("key"), q.get("acks", "all"), q.get("compression", "lz4"))
    if u.scheme in ("file", "") and uri:
        return Files(uri if u.scheme else os.path.abspath(uri), int(q["keep"]) if "keep" in q else None)
    raise ValueError(f"unknown sink {uri!r}")


class FanOut:
    """All sinks for each batch; a failing one is counted, or ends the stream under `abort`."""

    def __init__(self, sinks: list[Sink], on_error: str = "continue"):
        self.sinks, self.on_error = sinks, on_error

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        lines = batch.select(F.to_json(F.struct(*batch.columns)).alias("value")) if batch.columns != ["value"] else batch
        lines = lines.persist()
        try:
            n = lines.count()
            for s in self.sinks:
                try:
                    s(lines, epoch)
                    s.delivered += n
                except Exception:
                    s.failed += n
                    if self.on_error == "abort":
                        raise
        finally:
            lines.unpersist()
