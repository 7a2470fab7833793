"""Tables as immutable Parquet snapshots under one folder, with a log of commits.

A snapshot is a list of Parquet folders and files.  Inserts add a folder;
updates and deletes write those files anew that hold a row they change, and
keep the others.  ``_log/<number>.json`` holds the state of all
tables after a commit and appears whole and once, so a commit of several tables
is atomic and a second writer of the same table is found out.  The folder may be
in any file system that Spark reaches.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReadOnlyTransaction, SerializationFailure, UndefinedTable
from ..schema import Table


@dataclass
class State:
    """``paths`` and the last ``identity`` values of each table."""

    paths: dict[str, list[str]] = field(default_factory=dict)
    identity: dict[str, int] = field(default_factory=dict)

    def copy(self) -> State:
        return State({k: list(v) for k, v in self.paths.items()}, dict(self.identity))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_log"))

    def _entries(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/_log"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _entry(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_log/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def head(self) -> tuple[int, State]:
        numbers = self._entries()
        if not numbers:
            return 0, State()
        entry = self._entry(numbers[-1])
        return numbers[-1], State(entry["paths"], entry["identity"])

    def new_path(self, table: Table) -> str:
        return f"{self.root}/{table.source}/{uuid.uuid4().hex}"

    def files(self, folder: str) -> list[str]:
        """The names of a folder's Parquet files."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return sorted(n for n in names if n.endswith(".parquet") and not n.startswith(("_", ".")))

    def publish(self, base: int, state: State, written: set[str]) -> int:
        """Makes ``state`` of the written tables current, if nobody wrote them since ``base``."""
        while True:
            numbers = self._entries()
            number, head = (numbers[-1], self._entry(numbers[-1])) if numbers else (0, {"paths": {}, "identity": {}})
            for n in (n for n in numbers if n > base):
                both = set(self._entry(n)["written"]) & written
                if both:
                    raise SerializationFailure(f"{', '.join(sorted(both))} was written by another transaction")
            paths = head["paths"] | {t: state.paths[t] for t in written if t in state.paths}
            identity = head["identity"] | {k: v for k, v in state.identity.items() if k.partition(".")[0] in written}
            text = json.dumps({"paths": paths, "identity": identity, "written": sorted(written)})
            if self._put(number + 1, text):
                return number + 1

    def _put(self, number: int, text: str) -> bool:
        """Makes a log entry that is whole from the moment it is seen; false if the number is taken.

        Written aside, then linked (local files) or renamed, which neither
        replaces an entry nor shows a part of one.  Other file systems than local
        ones need a rename that is atomic and fails on an existing name.
        """
        aside, target = (self._path(f"{self.root}/_log/{name}") for name in (f".{uuid.uuid4().hex}.tmp", f"{number:012d}.json"))
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(aside.toUri().getPath(), target.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(target) and self._fs.rename(aside, target)
        finally:
            self._fs.delete(aside, False)


class View:
    """What one transaction, or one statement outside of any, sees and stages."""

    def __init__(self, store: Store, read_only: bool = False):
        self.store, self.read_only = store, read_only
        self.base, self.state = store.head()
        self.written: set[str] = set()

    def load(self, table: Table, paths: list[str] | None = None) -> DataFrame:
        """The table, or what of it stands in some of its paths."""
        if paths is None:
            paths = self.state.paths.get(table.source)
        if paths is None:
            raise UndefinedTable(f"table {table.source} does not exist")
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame([], table.stored)
        return spark.read.schema(table.stored).parquet(*paths)

    def located(self, table: Table) -> DataFrame:
        """The table with the file of each row as ``#file``."""
        df = self.load(table)
        return df.select("*", (F.col("_metadata.file_path") if self.state.paths[table.source] else F.lit(None)).alias("#file"))

    def split(self, table: Table, rows: DataFrame) -> tuple[list[str], list[str]]:
        """The paths of the files that hold one of the rows (by their ``#file``), and the other paths.

        What reaches the driver is a name for each file that is hit.  A folder
        without such a file stays one path.
        """
        names = {tuple(r[0].split("/")[-2:]) for r in rows.select("#file").distinct().collect()}
        folders = {folder for folder, _ in names}
        touched, kept = [], []
        for path in self.state.paths[table.source]:
            above, name = path.split("/")[-2:]
            if name in folders:
                for file in self.store.files(path):
                    (touched if (name, file) in names else kept).append(f"{path}/{file}")
            else:
                (touched if (above, name) in names else kept).append(path)
        return touched, kept

    def stage(self, table: Table, paths: list[str], identity: dict[str, int] | None = None) -> None:
        if self.read_only:
            raise ReadOnlyTransaction(f"cannot write {table.source} in a read-only transaction")
        self.state.paths[table.source] = paths
        self.state.identity.update(identity or {})
        self.written.add(table.source)

    def savepoint(self):
        return self.state.copy(), set(self.written)

    def restore(self, saved) -> None:
        self.state, self.written = saved[0].copy(), set(saved[1])

    def publish(self) -> None:
        if self.written:
            self.store.publish(self.base, self.state, self.written)
