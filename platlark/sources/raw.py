"""Fetched bodies kept as versions of an extract: an older one never takes the place of a newer one.

A version is a numbered claim that is created exclusively and names its body's file and
stamp.  A writer reads the last claim, checks the stamps, saves its body under a name of its own and
claims the next number; if another writer was faster, it looks again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

from platlark.operators.lifecycle import Folder
from platlark.operators.runs import Refused, newer_or_same


class Extract:
    """The versions of one extract in a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Folder(spark, folder)

    def _claims(self) -> list[str]:
        return [n for n in self.files.names() if n.startswith("version-")]

    def current(self) -> dict | None:
        """number, stamp and file of the last version whose claim can be read; a claim may still be being written."""
        for name in reversed(self._claims()):
            for _ in range(20):
                try:
                    return json.loads(self.files.read(name))
                except ValueError:
                    time.sleep(0.05)
        return None

    def path(self) -> str | None:
        """The address of the last version's body."""
        now = self.current()
        return f"{self.files.root.toString()}/{now['file']}" if now else None

    def save(self, blocks: Iterable[bytes], stamp: str | None, tries: int = 20) -> dict:
        """Keeps a body of this stamp as the next version; refused if a newer one is there."""
        name = f"body-{uuid.uuid4().hex}"
        saved = False
        for _ in range(tries):
            now = self.current()
            try:
                newer_or_same(stamp, now["stamp"] if now else None)
            except Refused:
                if saved:
                    self.files.drop(name)
                raise
            if not saved:
                self.files.write(name, blocks, over=False)
                saved = True
            claims = self._claims()
            number = int(claims[-1].removeprefix("version-")) + 1 if claims else 1
            if self.current() != now:
                continue
            claim = {"number": number, "stamp": stamp, "file": name}
            try:
                self.files.create(f"version-{number:08d}", json.dumps(claim).encode())
                return claim
            except FileExistsError:
                continue
        self.files.drop(name)
        raise Refused("other writers were faster each time")
