"""One JSON document from parallel tasks: each writes a part, the commit joins the parts in order and puts the whole in place.

The parts lie in a hidden folder beside the target, on any file system that Arrow opens by
its address and that driver and executors share.  A task's part is known by a name of its own,
so a repeated or speculative attempt never mixes with another; only parts whose tasks
reported are joined.  The target appears by a rename or not at all, and a failed
job leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch, fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are copied at once when parts are joined.
COPY = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str | None


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.head, self.tail, self.between = options["path"], options.get("head", "["), options.get("tail", "]"), options.get("between", ",\n")
        self.overwrite = overwrite
        where, _, name = self.path.rstrip("/").rpartition("/")
        self.parts = f"{where}/.{name}-{uuid.uuid4().hex}"

    def _open(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, iterator: Iterator[RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, out = None, None
        try:
            for b in iterator:
                for text in b.column(0).to_pylist():
                    if text is None:
                        continue
                    if out is None:
                        files, folder = self._open(self.parts)
                        files.create_dir(folder, recursive=True)
                        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
                        out = files.open_output_stream(name)
                        out.write(text.encode())
                    else:
                        out.write((self.between + text).encode())
        finally:
            if out is not None:
                out.close()
        return Part(task.partitionId(), name)

    def commit(self, messages: list[Part | None]) -> None:
        files, target = self._open(self.path)
        if not self.overwrite and files.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        _, folder = self._open(self.parts)
        files.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        try:
            with files.open_output_stream(whole) as out:
                out.write(self.head.encode())
                first = True
                for part in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.number):
                    if not first:
                        out.write(self.between.encode())
                    first = False
                    with files.open_input_stream(part.name) as piece:
                        while block := piece.read(COPY):
                            out.write(block)
                out.write(self.tail.encode())
            if files.get_file_info(target).type == fs.FileType.Directory:
                files.delete_dir(target)
            files.move(whole, target)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = self._open(self.parts)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class MapDocument(DataSource):
    """A sink for a column of JSON texts, written in the order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if len(schema.fields) != 1:
            raise ValueError("one column of JSON texts is written")
        return DocumentWriter(dict(self.options), overwrite)


def save(texts: DataFrame, path: str, head: str, tail: str, mode: str = "errorifexists") -> None:
    """``texts`` (one column, in order) as one document; with ``errorifexists`` a target that is there stays."""
    texts.sparkSession.dataSource.register(MapDocument)
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"a document is new or written over, not {mode}")
    texts.write.format("json_document").mode("overwrite" if mode == "overwrite" else "append").options(path=path, head=head, tail=tail).save()
