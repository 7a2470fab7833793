"""Import and export as lines of tab-separated text with ``\\N`` for null."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import as_text
from ..plans.frames import build
from ..schema import Table

#: Characters that lines escape.
ESCAPES = [("\\", "\\\\"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v")]


def escape_line(values) -> str:
    """One line of already textual values."""
    out = []
    for v in values:
        text = "\\N" if v is None else str(v)
        if v is not None:
            for raw, escaped in ESCAPES:
                text = text.replace(raw, escaped)
        out.append(text)
    return "\t".join(out)


def _line(df: DataFrame, kinds):
    parts = []
    for name, kind in zip(df.columns, kinds, strict=True):
        text = as_text(F.col(f"`{name}`"), kind)
        for raw, escaped in ESCAPES:
            text = F.replace(text, F.lit(raw), F.lit(escaped))
        parts.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("\t", *parts)


def line_frame(query) -> DataFrame:
    df = build(query.node, query._database().load)
    return df.select(_line(df, [e.kind for e in query.node.outputs]).alias("value"))


def copy_to(query, path: str) -> None:
    """Writes the result as text files, each executor its own part."""
    line_frame(query).write.text(path)


def copy_lines(query):
    """The result's lines, one partition at a time."""
    return (r["value"] for r in line_frame(query).toLocalIterator())


def _unescaped(cell):
    """A cell's text: each escape is read once, from the left."""
    marked = F.replace(cell, F.lit("\\\\"), F.lit("\x00"))
    for raw, escaped in ESCAPES[1:]:
        marked = F.replace(marked, F.lit(escaped), F.lit(raw))
    return F.when(cell != "\\N", F.replace(marked, F.lit("\x00"), F.lit("\\")))


def read_lines(db, table: Table, path: str | list[str]) -> DataFrame:
    """Rows of the table's writable columns, in declared order, under database names."""
    keys = [k for k, c in table.columns.items() if c.writable]
    cells = F.split(F.col("value"), "\t")
    lines = db.spark.read.text(path).where(F.col("value") != "\\.").select(cells.alias("cells"))
    return lines.select(*[_unescaped(F.col("cells")[i]).cast(_plain_type(table.columns[k].kind.spark)).alias(table.db_name(k)) for i, k in enumerate(keys)])


def _plain_type(kind: T.DataType):
    if isinstance(kind, (T.ArrayType, T.StructType)):
        raise TypeError("lines hold plain values")
    return kind


def copy_from(db, table: Table, path: str | list[str]) -> int:
    """Appends the lines of a text file or folder; returns how many."""
    if any(not c.writable for c in table.columns.values()):
        raise TypeError("lines are for tables whose columns are all written")
    return _append(db, table, read_lines(db, table, path))


def copy_rows(db, table: Table, rows) -> int:
    """Appends rows given as tuples of the table's columns."""
    return _append(db, table, db.spark.createDataFrame([tuple(r) for r in rows], table.stored))


def _append(db, table: Table, df: DataFrame) -> int:
    from ..operators.write import Write

    with db._writing() as view:
        write = Write(table, db)
        path, written = write._write(view, df.select(*[F.col(f"`{table.db_name(k)}`").cast(c.kind.spark) for k, c in table.columns.items()]))
        write._check_nulls(written)
        before = view.state.paths.get(table.source, [])
        write._check_unique(written, [view.load(table, before)], write._unique_keys())
        view.stage(table, [*before, path])
        return written.count()


class CopyReader(io.TextIOBase):
    """Reads a result's lines, partition by partition."""

    def __init__(self, query):
        self._lines, self._rest = copy_lines(query), ""

    def readable(self) -> bool:
        return True

    def readline(self, size: int = -1) -> str:
        line = self._rest or next((text + "\n" for text in self._lines), "")
        if 0 <= size < len(line):
            line, self._rest = line[:size], line[size:]
        else:
            self._rest = ""
        return line

    def read(self, size: int = -1) -> str:
        out = []
        while size < 0 or sum(map(len, out)) < size:
            piece = self.readline(-1 if size < 0 else size - sum(map(len, out)))
            if not piece:
                break
            out.append(piece)
        return "".join(out)


class CopyWriter(io.TextIOBase):
    """Takes lines in batches of ``BATCH``; closing it publishes all of them, leaving by an error none."""

    BATCH = 50_000

    def __init__(self, db, table: Table):
        self._db, self._table, self._text, self._lines, self._frames = db, table, "", [], []
        self.row_count = 0

    def writable(self) -> bool:
        return True

    def write(self, text: str) -> int:
        whole = (self._text + text).split("\n")
        self._text = whole.pop()
        self._lines += [line for line in whole if line != "\\."]
        if len(self._lines) >= self.BATCH:
            self._spill()
        return len(text)

    def _spill(self) -> None:
        if self._lines:
            path = f"{self._db.store.new_path(self._table)}-lines"
            self._db.spark.createDataFrame([(x,) for x in self._lines], "value string").write.text(path)
            self._frames.append(path)
            self._lines = []

    def __exit__(self, kind, *_):
        if kind is None:
            self.close()

    def close(self) -> None:
        if not self.closed:
            if self._text:
                self.write("\n")
            self._spill()
            if self._frames:
                self.row_count = copy_from(self._db, self._table, self._frames)
            super().close()
