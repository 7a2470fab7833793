"""What every query has: running, result shapes, tags, and guards against use without running."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import NoRowError, RowCountError, TooManyRowsError


class Query:
    """``execute()`` runs it in the shape chosen; ``_rows(limit)`` is what shapes are made of."""

    _shape: str = "rows"
    _error: Callable | None = None
    _expected: int | None = None
    _tag: str | None = None

    def __iter__(self):
        raise TypeError("the query was not run; call execute()")

    def __bool__(self):
        raise TypeError("the query was not run; call execute()")

    def __await__(self):
        raise TypeError("queries are run by execute(), not awaited")

    def _with(self, **changes):
        made = object.__new__(type(self))
        made.__dict__.update(self.__dict__)
        made.__dict__.update(changes)
        return made

    def tag(self, name: str):
        return self._with(_tag=name)

    def take_first(self):
        return self._with(_shape="first")

    def take_value(self):
        return self._one_column()._with(_shape="value")

    def expect_non_empty(self, error=None):
        return self._with(_shape="some", _error=error)

    def expect_first(self, error=None):
        return self._with(_shape="needed", _error=error)

    def expect_one(self, error=None):
        return self._with(_shape="one", _error=error)

    def expect_at_most_one(self, error=None):
        return self._with(_shape="one or none", _error=error)

    def expect_value(self, error=None):
        return self._one_column()._with(_shape="needed value", _error=error)

    def _one_column(self):
        if len(self._keys()) != 1:
            raise ValueError("a value needs exactly one selected column")
        return self

    def _fail(self, error):
        raise self._error(error) if self._error else error

    def _shaped(self, rows: Callable[[int | None], list], count: Callable[[], int]):
        shape = self._shape
        if shape == "rows":
            return rows(None)
        if shape == "some":
            found = rows(None)
            return found if found else self._fail(NoRowError())
        found = rows(2 if shape.startswith("one") else 1)
        if shape.startswith("one") and len(found) > 1:
            self._fail(TooManyRowsError(count()))
        if not found:
            return None if shape in ("first", "value", "one or none") else self._fail(NoRowError())
        return next(iter(found[0].values())) if shape.endswith("value") else found[0]

    def _check_count(self, actual: int) -> None:
        if self._expected is not None and actual != self._expected:
            self._fail(RowCountError(self._expected, actual))
