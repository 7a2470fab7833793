"""``case when … then … else … end``; the first typed result decides the kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds as K
from ..errors import KindError
from ..kinds import comparable, kind_of
from ..plans.expr import Expr, lowers


class Case:
    def __init__(self, builder, branches=(), default=None):
        self._builder, self._branches, self._default = builder, branches, default

    def when(self, test: Expr, result) -> Case:
        if test.kind.name != "boolean":
            raise KindError("when takes a condition")
        return Case(self._builder, (*self._branches, (test, result)), self._default)

    def else_(self, result) -> Case:
        return Case(self._builder, self._branches, (result,))

    def end(self) -> Expr:
        results = [r for _, r in self._branches] + list(self._default or ())
        if not self._branches:
            raise KindError("a case needs a when")
        typed = next((r.kind for r in results if isinstance(r, Expr)), None) or next((kind_of(r) for r in results if r is not None), None)
        if typed is None:
            raise KindError("a case needs a result that is not null")
        wide = typed
        for r in results:
            kind = r.kind if isinstance(r, Expr) else None if r is None else kind_of(r)
            if kind is not None and not comparable(typed, kind):
                raise KindError(f"a case of {typed} and {kind}")
            if kind is not None and isinstance(r, Expr) and kind.name in K.NUMERIC:
                wide = K.wider(wide, kind) if wide.name != kind.name else wide
        exprs = [r if isinstance(r, Expr) else Expr("value", (), wide, r) for r in results]
        args = []
        for (test, _), result in zip(self._branches, exprs, strict=False):
            args += [test, result]
        if self._default is not None:
            args.append(exprs[-1])
        return Expr("case", tuple(args), wide)


@lowers("case")
def _case(expr: Expr, *cols: Column) -> Column:
    cast = (lambda c: c) if expr.kind.name == "decimal" else (lambda c: c.cast(expr.kind.spark))
    out = None
    for test, result in zip(cols[0::2], cols[1::2], strict=False):
        out = F.when(test, cast(result)) if out is None else out.when(test, cast(result))
    return out.otherwise(cast(cols[-1])) if len(cols) % 2 else out
