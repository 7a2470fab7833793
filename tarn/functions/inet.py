"""Network addresses: text in, ordered and compared by family, network bits, length and address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Expr, lowers


@lowers("inet.is_subnet_of", "inet.is_subnet_or_equal", "inet.is_supernet_of", "inet.is_supernet_or_equal", "inet.overlaps")
def _test(expr: Expr, a: Column, b: Column) -> Column:
    x, y = _parts(a), _parts(b)
    inner, outer = (x, y) if "subnet" in expr.op else (y, x)
    same = lambda bits: (x["family"] == y["family"]) & (F.substring(x["bits"], F.lit(1), bits) == F.substring(y["bits"], F.lit(1), bits))
    if expr.op == "inet.overlaps":
        return same(F.least(x["len"], y["len"]))
    longer = inner["len"] >= outer["len"] if "equal" in expr.op else inner["len"] > outer["len"]
    return longer & same(outer["len"])


def _parts(col: Column) -> Column:
    """``family``, the address as a string of bits, and the length of its network, natively for both families."""
    address, given = F.split_part(col, F.lit("/"), F.lit(1)), F.split_part(col, F.lit("/"), F.lit(2))
    octets = F.split(address, "[.]")
    v4 = F.concat(*[F.lpad(F.conv(octets[i], 10, 2), 8, "0") for i in range(4)])
    # the groups around :: are filled up with zeros
    head, tail = F.split_part(address, F.lit("::"), F.lit(1)), F.split_part(address, F.lit("::"), F.lit(2))
    groups = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))
    gap = F.when(F.contains(address, F.lit("::")), 8 - F.size(groups(head)) - F.size(groups(tail))).otherwise(0)
    whole = F.concat(groups(head), F.array_repeat(F.lit("0"), gap), groups(tail))
    v6 = F.array_join(F.transform(whole, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    is_six = F.contains(address, F.lit(":"))
    size = F.when(is_six, 128).otherwise(32)
    length = F.when(given == "", size).otherwise(F.nullif(given, F.lit("")).cast("int"))
    return F.when(col.isNotNull(), F.struct(F.when(is_six, 6).otherwise(4).alias("family"), F.when(is_six, v6).otherwise(v4).alias("bits"), length.alias("len")))


def inet_key(col: Column) -> Column:
    """Orders addresses: family, network, network length, address."""
    p = _parts(col)
    network = F.rpad(F.substring(p["bits"], F.lit(1), p["len"]), 128, "0")
    return F.when(col.isNotNull(), F.struct(p["family"].alias("family"), network.alias("network"), p["len"].alias("len"), p["bits"].alias("bits")))
