"""Small column functions on names, strands, tags and attribute strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chr_name(c: Column) -> Column:
    """The chromosome's name with its ``chr`` in front."""
    return F.when(F.startswith(c, F.lit("chr")), c).otherwise(F.concat(F.lit("chr"), c))


def strand(c: Column) -> Column:
    """Strand of an orientation such as F/R: '-' if it is '-' or starts with R, else '+'."""
    return F.when((c == "-") | F.startswith(c, F.lit("R")), F.lit("-")).otherwise(F.lit("+"))


def orientation(flag: Column) -> Column:
    """Read strand / mate strand as F or R, from the SAM flag."""
    side = lambda bit: F.when(flag.bitwiseAND(bit) != 0, F.lit("R")).otherwise(F.lit("F"))
    return F.concat(side(16), F.lit("/"), side(32))


def within(a: Column, b: Column, w: int) -> Column:
    return F.abs(a - b) <= w


def length_similar(a: Column, b: Column) -> Column:
    """Whether two lengths differ by no more than a tenth of the longer one, rounded down, or 5."""
    return F.abs(a - b) <= F.greatest(F.lit(5), F.floor(F.greatest(a, b) / 10))


def similar_lengths(a: int, b: int) -> bool:
    """``length_similar`` for numbers."""
    return abs(a - b) <= max(5, max(a, b) // 10)


def overlap_closed(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return (a2 >= b1) & (a1 <= b2)


def contained(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return (a1 >= b1) & (a2 <= b2)


def end_of(svtype: Column, pos: Column, length: Column) -> Column:
    """Last base of a deletion, else the position."""
    return F.when(svtype == "DEL", pos + length - 1).otherwise(pos)


def sv_length(given: Column, svtype: Column, start: Column, end: Column) -> Column:
    """The given length if it is a number, else the span: negative for deletions, positive for insertions."""
    span = end - start + 1
    made = F.when(F.upper(svtype) == "DEL", -F.abs(span)).when(F.upper(svtype) == "INS", F.abs(span)).otherwise(span)
    return F.coalesce(given.cast("string").try_cast("int"), made)


def sa_entries(sa: Column, whole: bool = False) -> Column:
    """Valid entries of an SA tag (six comma fields, numbers where numbers belong) as (rname, pos, strand, cigar, mapq, nm).

    With ``whole``, the long-read rule, a tag with one bad entry has no entries.
    """
    fields = F.transform(F.filter(F.split(F.trim(sa), ";"), lambda e: e != ""), lambda e: F.split(e, ","))
    good = F.filter(fields, lambda f: (F.size(f) == 6) & F.get(f, 1).try_cast("int").isNotNull() & F.get(f, 4).try_cast("int").isNotNull() & F.get(f, 5).try_cast("int").isNotNull())
    number = lambda f, i: F.get(f, i).try_cast("int")
    if whole:
        good = F.when(F.size(good) == F.size(fields), good)
    return F.transform(good, lambda f: F.struct(F.get(f, 0).alias("rname"), number(f, 1).alias("pos"), F.get(f, 2).alias("strand"), F.get(f, 3).alias("cigar"), number(f, 4).alias("mapq"), number(f, 5).alias("nm")))


def attribute(attributes: Column, key: str) -> Column:
    """Value of the first ``key "value"`` or ``key value`` of a GTF attribute column; null if there is none."""
    found = F.regexp_extract(attributes, rf'(?:^|;)\s*{key}\s+"?([^";]*)"?', 1)
    return F.when(found != "", F.trim(found))
