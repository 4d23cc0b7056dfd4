"""CIGAR strings as arrays of (i, op, len), and cursors over them. Everything stays inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REF, READ = ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S")


def is_cigar(c: Column) -> Column:
    """Whether the string is operations only, without a rest."""
    return c.rlike("^([0-9]+[MIDNSHP=X])+$")


def ops(c: Column) -> Column:
    """Operations in order, numbered from 0; null for null, empty for '*'."""
    parts = F.regexp_extract_all(c, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda x, i: F.struct(i.alias("i"), F.right(x, F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def consumed(operations: Column, kinds: tuple[str, ...]) -> Column:
    """Sum of the lengths of these kinds of operation."""
    return F.aggregate(operations, F.lit(0), lambda acc, x: acc + F.when(x["op"].isin(*kinds), x["len"]).otherwise(F.lit(0)))


def ref_span(operations: Column) -> Column:
    """Bases of the reference that the alignment covers."""
    return consumed(operations, REF)


def placed(operations: Column, wanted) -> Column:
    """The operations that pass ``wanted``, with the bases of reference (ref) and read (read) in front of each.

    One fold with both cursors, so a read costs in proportion to its operations; what passes is added to the result.
    """
    none = F.array().cast("array<struct<i:int,op:string,len:int,ref:int,read:int>>")

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["i"].alias("i"), x["op"].alias("op"), x["len"].alias("len"), acc["ref"].alias("ref"), acc["read"].alias("read"))
        on = lambda c, kinds: (acc[c] + F.when(x["op"].isin(*kinds), x["len"]).otherwise(F.lit(0))).alias(c)
        return F.struct(on("ref", REF), on("read", READ), F.when(wanted(x), F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(operations, F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), none.alias("out")), step, lambda acc: acc["out"])


def is_poly_at(seq: Column, min_len: Column | int = 20, share: float = 0.8) -> Column:
    """Whether a sequence of at least ``min_len`` bases is A, or T, to this share. False for null and empty."""
    u = F.upper(seq)
    n = F.length(u)
    of = lambda b: (n - F.length(F.replace(u, F.lit(b), F.lit("")))) / n
    least = min_len if isinstance(min_len, Column) else F.lit(min_len)
    return F.coalesce(F.when((n == 0) | (n < least), F.lit(False)).otherwise(F.greatest(of("A"), of("T")) >= share), F.lit(False))
