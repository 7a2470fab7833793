"""Errors that queries, writes and transactions raise."""

from __future__ import annotations


class TarnError(Exception):
    """Base of all errors of this library."""


class KindError(TarnError, TypeError):
    """An expression's kind does not fit where it is used."""


class ScopeError(TarnError):
    """A reference to a table or column that is not in scope, or a name used twice."""


class UnsupportedError(TarnError):
    """The value or format cannot be matched exactly, so nothing is computed."""


class UndefinedParameterError(TarnError, TypeError):
    """``UNSET`` or ``None`` where a value is needed."""


class QueryError(TarnError):
    """The engine failed while it ran a query."""


class UndefinedTable(QueryError):
    pass


class UndefinedColumn(QueryError):
    pass


class QueryCanceled(QueryError):
    pass


class DecodeError(TarnError):
    """A codec could not read a value."""


class NoRowError(TarnError):
    def __init__(self):
        super().__init__("no row, one was expected")


class TooManyRowsError(TarnError):
    def __init__(self, count: int):
        super().__init__(f"{count} rows, one at most was expected")
        self.count = count


class RowCountError(TarnError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"{actual} rows, {expected} were expected")
        self.expected, self.actual = expected, actual


class InvalidCursorError(TarnError):
    """A pagination cursor that was altered or belongs to another query."""


class ConstraintViolation(TarnError):
    def __init__(self, message: str, table: str, columns: tuple[str, ...] = ()):
        super().__init__(message)
        self.table, self.columns = table, columns


class UniqueViolation(ConstraintViolation):
    pass


class NotNullViolation(ConstraintViolation):
    pass


class CheckViolation(ConstraintViolation):
    pass


class ReadOnlyTransaction(TarnError):
    pass


class SerializationFailure(TarnError):
    """Another writer published a version of the same table first."""


class TransactionTimeout(TarnError):
    pass


class TransactionRolledBack(TarnError):
    """A commit after a statement of the transaction failed."""


class BatchError(TarnError):
    """``outcomes`` holds, by position, each query's result or error."""

    def __init__(self, outcomes: list):
        super().__init__(f"{sum(isinstance(o, Exception) for o in outcomes)} of {len(outcomes)} queries failed")
        self.outcomes = outcomes


def violated_columns(error: BaseException, table) -> tuple[str, ...] | None:
    """Keys of the columns a constraint violation is about, if it is about this table."""
    return error.columns if isinstance(error, ConstraintViolation) and error.table == table.source else None
