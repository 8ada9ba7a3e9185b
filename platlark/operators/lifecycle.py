"""The life of a batch run: submitted once, recorded, followed, cancelled, its results saved once.

Files lie in one folder of any file system that Spark reaches; the service is whatever
object is handed in as ``transport``, with ``post(requests)``, ``batches()``,
``batch(id)``, ``cancel(id)``, ``results(id)`` and ``models()``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import SparkSession

from platlark.operators.runs import Refused, guard

PENDING, LATEST = "pending.json", "latest.json"


class Rejected(RuntimeError):
    """The service answered that it made no batch."""


class Transport(Protocol):
    def post(self, requests: list[dict]) -> dict: ...
    def batches(self) -> list[dict]: ...
    def batch(self, batch_id: str) -> dict: ...
    def cancel(self, batch_id: str) -> dict: ...
    def results(self, batch_id: str) -> Iterable[bytes]: ...
    def models(self) -> list[str]: ...


class Folder:
    """Small files of a shared folder, each put in place by a rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.root)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def holds(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), False)

    def read(self, name: str) -> bytes:
        """A file's content; that of the old one while a new one is put in place."""
        if not self.holds(name) and self.holds(f".{name}.old"):
            name = f".{name}.old"
        size = self.fs.getFileStatus(self._at(name)).getLen()
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def create(self, name: str, content: bytes = b"") -> None:
        """A small file that was not there: of several writers one succeeds, the others get an error."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self.holds(name):
                raise FileExistsError(name) from e
            raise
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def write(self, name: str, blocks: Iterable[bytes], over: bool = True) -> None:
        """All blocks or nothing; without ``over`` an existing file stays and is an error.

        The old file steps aside before the new one takes its place and comes back if that
        fails, so one of them is always there under its name or as ``.old``.
        """
        if self.holds(name) and not over:
            raise FileExistsError(name)
        part, old = self._at(f".{name}.{uuid.uuid4().hex}.part"), self._at(f".{name}.old")
        stream = self.fs.create(part, True)
        try:
            for block in blocks:
                stream.write(bytearray(block))
        finally:
            stream.close()
        aside = self.holds(name)
        if aside:
            self.fs.delete(old, False)
            self.fs.rename(self._at(name), old)
        if not self.fs.rename(part, self._at(name)):
            if aside:
                self.fs.rename(old, self._at(name))
            raise OSError(f"{name} could not be put in place")
        if aside:
            self.fs.delete(old, False)

    def write_json(self, name: str, value, over: bool = True, indent: int | None = None) -> None:
        self.write(name, [json.dumps(value, ensure_ascii=False, indent=indent).encode()], over)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.root) if not x.getPath().getName().startswith("."))


class RunLog:
    """Run records of a folder: one file for each batch, a pointer to the latest, a marker while a submission is open."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Folder(spark, folder)

    def records(self) -> list[dict]:
        """Every record that can be read, the earliest first."""
        found = []
        for name in self.files.names():
            if name.endswith(".json") and name not in (PENDING, LATEST):
                try:
                    record = json.loads(self.files.read(name))
                except ValueError:
                    continue
                if isinstance(record, dict) and record.get("batch_id"):
                    found.append(record)
        return sorted(found, key=lambda r: (r.get("submitted", ""), r["batch_id"]))

    def latest(self) -> dict | None:
        return json.loads(self.files.read(LATEST)) if self.files.holds(LATEST) or self.files.holds(f".{LATEST}.old") else None

    def record(self, batch_id: str | None) -> dict:
        """The record of a batch; without an id the latest."""
        found = [r for r in self.records() if r["batch_id"] == batch_id] if batch_id else [x for x in [self.latest()] if x]
        if not found:
            raise Refused(f"no record of {batch_id or 'any run'}")
        return found[0]

    def keep(self, record: dict) -> None:
        self.files.write_json(f"{record['batch_id']}.json", record, indent=1)
        self.files.write_json(LATEST, record, indent=1)

    def submit(self, transport: Transport, requests: list[dict], record: dict, confirmed: bool = False, again: bool = False, most: int | None = None) -> dict | None:
        """Sends the requests once; None if nothing was sent because it is not confirmed.

        The marker is written before the service is called.  It goes when the record is
        stored, or when the service says that it made no batch; any other failure leaves
        it, since a batch may exist, and ``reconcile`` must be asked first.
        """
        same = any(r.get("digest") == record["digest"] for r in self.records())
        if not guard(self.files.holds(PENDING), same, again, len(requests), confirmed, *([most] if most else [])):
            return None
        try:
            self.files.create(PENDING, json.dumps(record, ensure_ascii=False).encode())  # of two submitters one goes on
        except FileExistsError as e:
            raise Refused("a submission is pending; reconcile it first") from e
        try:
            made = transport.post(requests)
        except Rejected as e:
            self.files.drop(PENDING)
            raise Refused(str(e)) from e
        done = {**record, "batch_id": made["id"]}
        self.keep(done)
        self.files.drop(PENDING)
        return done

    def reconcile(self, transport: Transport, settle: bool = False) -> list[dict]:
        """Batches of the account without a record; ``settle`` drops the marker once they have been seen."""
        known = {r["batch_id"] for r in self.records()}
        orphans = [b for b in transport.batches() if b["id"] not in known]
        if settle:
            self.files.drop(PENDING)
        return orphans

    def verify(self, transport: Transport, model: str) -> bool:
        if model not in transport.models():
            raise Refused(f"the service does not list {model}")
        return True

    def cancel(self, transport: Transport, batch_id: str | None = None) -> dict:
        return transport.cancel(self.record(batch_id)["batch_id"])

    def status(self, transport: Transport, batch_id: str | None = None) -> dict:
        return transport.batch(self.record(batch_id)["batch_id"])

    def download(self, transport: Transport, batch_id: str | None = None, force: bool = False) -> str:
        """Saves the results block by block; a file that is there is kept unless forced.  A batch that has not ended is refused."""
        own = self.record(batch_id)["batch_id"]
        name = f"{own}.results.jsonl"
        if force or not self.files.holds(name):
            now = transport.batch(own)
            state = now.get("processing_status", now.get("status"))
            if state != "ended":
                raise Refused(f"{own} is {state or 'of unknown state'}; its results are not whole yet")
            self.files.write(name, transport.results(own))
        return f"{self.files.root.toString()}/{name}"
