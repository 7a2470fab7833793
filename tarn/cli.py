"""``python -m tarn.cli verify MODULE:TABLES --data FOLDER [--format pretty|table|github|json] [--strict]``

Exit codes: 0 when all fits, 1 when something differs, 2 when it could not run.
"""

from __future__ import annotations

import argparse
import importlib
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarn", description="Checks declared tables against stored ones.")
    parser.add_argument("command", choices=["verify"])
    parser.add_argument("tables", help="module:name of a list of tables")
    parser.add_argument("--data", help="folder of <table>.parquet")
    parser.add_argument("--store", help="folder of a snapshot store")
    parser.add_argument("--format", default="pretty", choices=["pretty", "table", "github", "json"])
    parser.add_argument("--strict", action="store_true", help="warnings count as errors")
    try:
        args = parser.parse_args(argv)
        from pyspark.sql import SparkSession

        from .database import Database

        module, _, name = args.tables.partition(":")
        sys.path.insert(0, "")
        tables = getattr(importlib.import_module(module), name or "tables")
        db = Database(SparkSession.builder.getOrCreate(), args.data, args.store)
        report = db.verify(list(tables), args.strict)
    except SystemExit as e:
        return 2 if e.code else 0
    except Exception as e:  # noqa: BLE001  anything that keeps it from running is exit code 2
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(report.render(args.format))
    return report.exit_code


if __name__ == "__main__":
    sys.exit(main())
