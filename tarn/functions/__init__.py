"""Lowerings of all operations; importing the package registers them."""

from . import aggregates, arithmetic, arrays, case, dates, fts, inet, jsonb, predicates, ranges, raw, strings, vectors  # noqa: F401
