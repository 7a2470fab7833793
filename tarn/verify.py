"""Checks declared tables against stored ones: rules, report, renderers, exit codes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import UndefinedTable
from .schema import Table


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    code: str
    message: str
    table: str
    column: str | None = None
    key: str | None = None
    expected: str | None = None
    actual: str | None = None
    fix: str | None = None


@dataclass(frozen=True)
class Report:
    diagnostics: tuple[Diagnostic, ...]
    tables: int
    strict: bool = False

    @property
    def ok(self) -> bool:
        return not any(d.severity == "error" or self.strict for d in self.diagnostics)

    @property
    def exit_code(self) -> int:
        return 0 if self.ok else 1

    def render(self, form: str = "pretty") -> str:
        if form == "json":
            return json.dumps({"ok": self.ok, "tables": self.tables, "diagnostics": [asdict(d) for d in self.diagnostics]}, indent=2)
        if form == "github":
            return "\n".join(f"::{d.severity} title={d.code}::{d.message}" for d in self.diagnostics)
        if form == "table":
            rows = [("severity", "rule", "table", "column", "message"), *((d.severity, d.code, d.table, d.column or "", d.message) for d in self.diagnostics)]
            widths = [max(len(r[i]) for r in rows) for i in range(5)]
            return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)
        if form != "pretty":
            raise ValueError(f"{form!r} is no format")
        lines = []
        for d in self.diagnostics:
            lines.append(f"{d.severity}: {d.message} [{d.code}]")
            if d.expected or d.actual:
                lines.append(f"  declared {d.expected or 'nothing'}, stored {d.actual or 'nothing'}")
            if d.fix:
                lines.append(f"  fix: {d.fix}")
        errors = sum(d.severity == "error" for d in self.diagnostics)
        lines.append(f"{self.tables} tables, {errors} errors, {len(self.diagnostics) - errors} warnings")
        return "\n".join(lines)


def _stored_type(t: T.DataType) -> str:
    return t.simpleString()


def compare(table: Table, schema: T.StructType, labels=None) -> list[Diagnostic]:
    """What differs between a declared table and a stored schema."""
    out = []
    stored = {f.name: f for f in schema}
    names = {table.db_name(k): k for k in table.columns}

    def add(severity, code, message, column=None, key=None, expected=None, actual=None, fix=None):
        out.append(Diagnostic(severity, code, message, table.source, column, key, expected, actual, fix))

    for name, key in names.items():
        c, at = table.columns[key], f"{table.source}.{name}"
        want = c.kind.spark.simpleString()
        if name not in stored:
            add("error", "column-missing", f"{at} is missing", name, key, str(c.kind), None, f"ALTER TABLE {table.source} ADD COLUMN {name} {want}")
            continue
        f = stored[name]
        have = _stored_type(f.dataType)
        meta = f.metadata or {}
        if have != want or meta.get("kind", str(c.kind)) != str(c.kind):
            add("error", "column-type-mismatch", f"{at} is {meta.get('kind', have)}", name, key, str(c.kind), meta.get("kind", have), f"ALTER TABLE {table.source} ALTER COLUMN {name} TYPE {want}")
        if "fill" in meta:
            fill, own = meta["fill"] or None, c.fill
            if own == "identity" and fill != "identity":
                add("error", "column-identity-missing", f"{at} is no identity column", name, key, "identity", fill)
            elif own == "generated" and fill != "generated":
                add("warning", "column-generated-missing", f"{at} is not generated", name, key, "generated", fill)
            elif own == "default" and fill is None:
                add("error", "column-default-missing", f"{at} has no default", name, key, "default", None)
            elif fill == "identity" and own != "identity":
                add("error", "column-identity-undeclared", f"{at} is an identity column", name, key, own, "identity")
            elif fill == "generated" and own != "generated":
                add("error", "column-generated-undeclared", f"{at} is generated", name, key, own, "generated")
            elif fill == "default" and own is None:
                add("warning", "column-default-undeclared", f"{at} has a default", name, key, None, "default")
        if labels and c.kind.name == "enum" and name in labels:
            found = labels[name]
            if set(found) - set(c.kind.labels):
                add("error", "enum-label-mismatch", f"{at} holds other labels", name, key, ", ".join(c.kind.labels), ", ".join(sorted(found)))
        if c.kind.name == "enum" and meta.get("labels"):
            have_labels = list(meta["labels"])
            if set(have_labels) != set(c.kind.labels):
                add("error", "enum-label-mismatch", f"{at} has other labels", name, key, ", ".join(c.kind.labels), ", ".join(have_labels))
            elif have_labels != list(c.kind.labels):
                add("warning", "enum-label-order", f"{at} orders its labels otherwise", name, key, ", ".join(c.kind.labels), ", ".join(have_labels))
        if "null" in meta or not f.nullable:
            stored_null = meta.get("null", f.nullable)
            if stored_null and not c.null:
                add("error", "column-nullable-mismatch", f"{at} allows null", name, key, "not null", "null")
            elif not stored_null and c.null:
                add("warning", "column-not-null-mismatch", f"{at} is never null", name, key, "null", "not null")
    for name in stored:
        if name not in names:
            add("warning", "column-extra", f"{table.source}.{name} is not declared", name, None, None, _stored_type(stored[name].dataType))
    return out


def verify(db, tables: list[Table], strict: bool = False) -> Report:
    """Compares schemas, and looks at the data for nulls and labels that were not declared."""
    found: list[Diagnostic] = []
    for table in tables:
        try:
            df = _raw(db, table)
        except UndefinedTable:
            found.append(Diagnostic("error", "table-missing", f"{table.source} is missing", table.source))
            continue
        enums = {table.db_name(k): k for k, c in table.columns.items() if c.kind.name == "enum" and table.db_name(k) in df.columns}
        needed = [table.db_name(k) for k, c in table.columns.items() if not c.null and table.db_name(k) in df.columns]
        checks = [F.max(F.col(f"`{n}`").isNull().cast("int")).alias(f"n{i}") for i, n in enumerate(needed)]
        # labels beyond the declared ones are few in a sane table; a set of them is bounded by what differs
        checks += [F.slice(F.collect_set(F.when(~F.col(f"`{n}`").isin(*table.columns[k].kind.labels), F.col(f"`{n}`"))), 1, 20).alias(f"e{i}") for i, (n, k) in enumerate(enums.items())]
        seen = df.agg(*checks).first() if checks else None
        labels = {n: seen[f"e{i}"] for i, n in enumerate(enums) if seen[f"e{i}"]} if seen else {}
        found += compare(table, df.schema, labels)
        for i, n in enumerate(needed):
            if seen[f"n{i}"]:
                found.append(Diagnostic("error", "column-nullable-mismatch", f"{table.source}.{n} holds null", table.source, n, None, "not null", "null"))
    return Report(tuple(found), len(tables), strict)


def _raw(db, table: Table):
    """The table as stored, with whatever columns it has."""
    from pyspark.errors import AnalysisException

    if db.store:
        from .sources.store import View

        view = db._view or View(db.store)
        paths = view.state.paths.get(table.source)
        if paths:
            return db.spark.read.parquet(*paths).drop("#hit")
        if paths is not None:
            return view.load(table)
    source = db.sources.get(table.source) if isinstance(db.sources, dict) else f"{db.sources}/{table.source}.parquet" if db.sources else None
    if source is None:
        raise UndefinedTable(table.source)
    try:
        return db.spark.read.parquet(source) if isinstance(source, str) else source
    except AnalysisException as e:
        raise UndefinedTable(table.source) from e
