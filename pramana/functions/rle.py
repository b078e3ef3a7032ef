"""Run-length masks as boxes, without making the bitmap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_counts(text) -> Column:
    """Run lengths of the compressed string form: 5 bits a character, a sign, from the third on relative to two before."""
    chars = F.transform(F.filter(F.split(_c(text), ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("k"), F.array().cast("array<long>").alias("out"))

    def take(a, c):
        x = a["x"].bitwiseOR(F.expr("shiftleft(0L, 0)") + (c.bitwiseAND(F.lit(31)).cast("long") * F.pow(F.lit(2.0), 5 * a["k"]).cast("long")))
        last = c.bitwiseAND(F.lit(32)) == 0
        signed = F.when(last & (c.bitwiseAND(F.lit(16)) != 0), x - F.pow(F.lit(2.0), 5 * (a["k"] + 1)).cast("long")).otherwise(x)
        full = F.when(F.size(a["out"]) > 2, signed + F.get(a["out"], F.size(a["out"]) - 2)).otherwise(signed)
        return F.struct(F.when(last, F.lit(0).cast("long")).otherwise(x).alias("x"), F.when(last, 0).otherwise(a["k"] + 1).alias("k"), F.when(last, F.array_append(a["out"], full)).otherwise(a["out"]).alias("out"))

    return F.aggregate(chars, start, take, lambda a: a["out"])


def runs_to_box(counts, height) -> Column:
    """Tight pixel box (x0, y0, x1, y1; ends exclusive) of column-major runs that start with zeros; null if empty."""
    h = _c(height).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("on"))

    def take(a, r):
        run = F.struct(a["pos"].alias("a"), (a["pos"] + r["n"] - 1).alias("b"))
        return F.struct((a["pos"] + r["n"]).alias("pos"), F.when((r["i"] % 2 == 1) & (r["n"] > 0), F.array_append(a["on"], run)).otherwise(a["on"]).alias("on"))

    on = F.aggregate(F.transform(_c(counts), lambda n, i: F.struct(i.alias("i"), n.cast("long").alias("n"))), start, take, lambda a: a["on"])
    column = lambda p: F.floor(p / h)
    crosses = lambda r: column(r["a"]) < column(r["b"])
    x0 = F.array_min(F.transform(on, lambda r: column(r["a"])))
    x1 = F.array_max(F.transform(on, lambda r: column(r["b"]))) + 1
    y0 = F.array_min(F.transform(on, lambda r: F.when(crosses(r), F.lit(0).cast("long")).otherwise(r["a"] % h)))
    y1 = F.array_max(F.transform(on, lambda r: F.when(crosses(r), h - 1).otherwise(r["b"] % h))) + 1
    return F.when(F.size(on) > 0, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
