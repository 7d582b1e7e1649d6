"""Notes written with compensation: file, event and document change together, and what was done is undone if a later step fails."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class WriteFailed(RuntimeError):
    """A step failed; what was done before it has been undone, but for what `undone` lacks."""

    def __init__(self, step: str, cause: Exception, undone: list[str], left: list[str]):
        super().__init__(f"{step}: {cause}" + (f"; not undone: {', '.join(left)}" if left else ""))
        self.step, self.undone, self.left = step, undone, left


@dataclass
class Steps:
    """Steps with what undoes each; a failure undoes those that were done, the last first."""

    done: list[tuple[str, Callable[[], None]]] = field(default_factory=list)

    def take(self, name: str, act: Callable[[], Callable[[], None]]) -> None:
        """act does a step and gives what undoes it."""
        try:
            self.done.append((name, act()))
        except Exception as e:
            undone, left = [], []
            for n, undo in reversed(self.done):
                try:
                    undo()
                    undone.append(n)
                except Exception:
                    left.append(n)
            raise WriteFailed(name, e, undone, left) from e


class Notes:
    """Files of notes below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"a path outside of the notes: {path!r}")
        return self._path(f"{self.root}/{path}")

    def read(self, path: str) -> str | None:
        if not self._fs.exists(self._at(path)):
            return None
        s = self._fs.open(self._at(path))
        try:
            return bytes(s.readAllBytes()).decode()
        finally:
            s.close()

    def put(self, path: str, text: str | None) -> None:
        """The file as a whole, by a file beside it and a rename; None takes it away."""
        at = self._at(path)
        if text is None:
            self._fs.delete(at, False)
            return
        beside = self._at(f"{path}.{time.time_ns()}.writing")
        s = self._fs.create(beside, True)
        s.write(bytearray(text.encode()))
        s.close()
        self._fs.delete(at, False)
        if not self._fs.rename(beside, at):
            self._fs.delete(beside, False)
            raise OSError(f"cannot rename to {path}")


def committed(notes: Notes, path: str, text: str, append_event: Callable[[], Callable[[], None]], upsert_document: Callable[[], Callable[[], None]]) -> None:
    """Writes a note, appends its event and upserts its document; each of the two does its work and gives what undoes it. After a failure file, log and documents are as before.

    What undoes an append or an upsert is, in stores of committed batches, the batch's withdrawal.
    """
    before = notes.read(path)

    def file() -> Callable[[], None]:
        notes.put(path, text)
        return lambda: notes.put(path, before)

    steps = Steps()
    steps.take("file", file)
    steps.take("event", append_event)
    steps.take("document", upsert_document)
