"""Ranks and as-of lookups along a chromosome.

A chromosome is cut into stretches. Each is a window of its own, and a row for each stretch carries what has to be known
across their edges, so rows of one chromosome are dealt out over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a stretch; a chromosome has some ten thousand of them, a row each in what carries over.
STRETCH = 1 << 14


def stretch_of(pos: str | Column) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / STRETCH)


def before(keys: list[str]):
    """All stretches in front of one."""
    return Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)


def ranked(rows: DataFrame, keys: list[str], pos: str, order: list[str], name: str, whole: bool = False) -> DataFrame:
    """``rows`` with their rank from 0 by (pos, order) among those of their keys, or with ``whole`` among all by (keys, pos, order)."""
    cut = rows.withColumn("_stretch", stretch_of(pos))
    counts = cut.groupBy(*keys, "_stretch").agg(F.count(F.lit(1)).alias("_k"))
    over = Window.orderBy(*keys, "_stretch").rowsBetween(Window.unboundedPreceding, -1) if whole else before(keys)
    counts = counts.select(*keys, "_stretch", F.coalesce(F.sum("_k").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(pos, *order)
    return cut.join(counts, [*keys, "_stretch"]).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).drop("_stretch", "_before")


def last_before(points: DataFrame, marks: DataFrame, key: str, at: str, pos: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``points`` with the value of the last mark, by (pos, order), at or in front of the position ``at``; null if there is none.

    The last mark of each stretch is carried into the stretches behind it, a row for each.
    """
    kind = marks.select(value.alias("v")).schema["v"].dataType
    m = marks.select(key, F.col(pos).cast("long").alias("_p"), F.lit(0).alias("_side"), F.struct(*order).alias("_o"), F.struct(value.alias("v")).alias("_v"))
    columns = [c for c in points.columns if c != key]
    none = {f"_c{i}": F.lit(None).cast(points.schema[c].dataType) for i, c in enumerate(columns)}
    m = m.withColumns(none)
    p = points.select(key, F.col(at).cast("long").alias("_p"), F.lit(1).alias("_side"), F.lit(None).cast(m.schema["_o"].dataType).alias("_o"), F.lit(None).cast(m.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    both = m.unionByName(p).withColumn("_stretch", stretch_of("_p"))
    slim = m.select(key, "_p", "_o", "_v", "_side").unionByName(p.select(key, "_p", "_o", "_v", "_side")).withColumn("_stretch", stretch_of("_p"))
    ends = slim.groupBy(key, "_stretch").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_p", "_o"))).alias("_end"))
    ends = ends.select(key, "_stretch", F.last("_end", ignorenulls=True).over(before([key])).alias("_carry"))
    inside = Window.partitionBy(key, "_stretch").orderBy("_p", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(ends, [key, "_stretch"]).withColumn("_found", F.coalesce(F.last("_v", ignorenulls=True).over(inside), "_carry"))
    return found.filter("_side = 1").select(key, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], F.col("_found.v").cast(kind).alias(name))


def furthest_before(points: DataFrame, marks: DataFrame, key: str, at: str, pos: str, end: str, name: str) -> DataFrame:
    """``points`` with the greatest end of the marks at or in front of the position ``at``; null if there is none.

    Whether a span meets any mark, or lies inside one, follows from it without a pair being made. Places are a row each.
    """
    marked = marks.select(key, F.col(pos).cast("long").alias("_p"), F.col(end).cast("long").alias("_v"))
    places = marked.unionByName(points.select(key, F.col(at).cast("long").alias("_p"), F.lit(None).cast("long").alias("_v"))).groupBy(key, "_p").agg(F.max("_v").alias("_v")).withColumn("_stretch", stretch_of("_p"))
    carried = places.groupBy(key, "_stretch").agg(F.max("_v").alias("_end")).select(key, "_stretch", F.max("_end").over(before([key])).alias("_carry"))
    inside = Window.partitionBy(key, "_stretch").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    found = places.join(carried, [key, "_stretch"]).select(key, "_p", F.greatest(F.max("_v").over(inside), "_carry").alias(name))
    return points.withColumn("_p", F.col(at).cast("long")).join(found, [key, "_p"], "left").select(*points.columns, name)
