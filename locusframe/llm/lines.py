"""Repeated passages, found by winnowing over word hashes and deleted behind their first place, whole lines and parts of lines.

DataFrame functions only. Lines of a text are units: a line with a word and the blank lines behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, unused
from .rules import SPACE, _let

#: A line feed in front of a line with a word; splitting there and joining by a line feed gives the text again.
_CUT = r"\n(?=[ \t\x0B\f\r]*[^ \t\n\x0B\f\r])"
_GAP, _BLANK = r"[ \t\n\x0B\f\r]", r"[ \t\x0B\f\r]"
_START = r"(?<![^ \t\n\x0B\f\r])"
_NO_ID = -(1 << 62)
#: So many groups of words are joined to one at a time; fingerprints are of so many words where windows are long enough.
RADIX = 7
#: Mean candidates of a window, rounds that take those out that no window selects, and how many in front of and behind one are looked at where no more are in reach.
CANDIDATES, ROUNDS, NEAR = 7, 3, 3
_PLACE = (1 << 31) - 1
#: Slots of the bits that tell which texts have a partner: 4 MB.
SLOTS = 1 << 25


def _units(text: Column) -> Column:
    return F.split(text, _CUT)


def _split(text: Column) -> Column:
    """The words: runs of characters other than ASCII white space."""
    for c in SPACE.replace(" ", ""):
        text = F.replace(text, F.lit(c), F.lit(" "))
    # a single character is split at without a regular expression
    return F.array_remove(F.split(text, " "), "")


def _words(text: Column) -> Column:
    """Hash of each word."""
    return F.transform(_split(text), lambda w: F.xxhash64(w))


def _over(values: Column, n: int, join, body, size: int = 1) -> Column:
    """``body`` of the array with ``join`` of each n neighbours, from groups of growing size; there must be n values."""
    if size == n:
        return body(values)
    wide = min(n, RADIX * size)
    places = [*range(size, wide - size, size), wide - size]
    both = F.transform(F.slice(values, F.lit(1), F.size(values) - (wide - size)), lambda x, i: join(x, *(F.get(values, i + p) for p in places)))
    return _let(both, lambda x: _over(x, n, join, body, wide))


def _ends(size: int, k: int) -> list[int]:
    """Places of groups of k words that cover ``size`` words, the last one flush with their end."""
    return [*range(0, size - k, k), size - k]


def _marks(hashes: Column, min_words: int) -> Column:
    """The hash a that each window of ``min_words`` words selects, once for all neighbouring windows s to e that share it, the hash c of their words, and at how many places in them it is.

    A place is k words of the window; its value is that of the first two. Places of low value are candidates: a window
    selects its least one, of equal ones the first, and the hash of its words; one without candidates its least value.
    So the words of a window decide what it selects, and most places are looked at once only.
    """
    k = min(RADIX, 1 << max(0, min_words.bit_length() - 2))
    width = min_words - k + 1
    low = min((1 << 63) - 1, -(1 << 63) + (CANDIDATES << 64) // width)

    def value(i: Column) -> Column:
        return F.get(hashes, i).bitwiseXOR(F.get(hashes, i + 1)) if k > 1 else F.get(hashes, i)

    # value and place in one number, whose order is that of the selection
    def packed(i: Column) -> Column:
        return value(i).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_PLACE)).cast("int")

    # neighbours that select one hash are one stretch, as where a text repeats itself at once
    def joined(marks: Column, places) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(marks) - 1), lambda j: (j == 0) | (F.get(marks, j)["a"] != F.get(marks, j - 1)["a"]) | (F.get(marks, j)["s"] != F.get(marks, j - 1)["e"] + 1))

        def mark(first: Column, last: Column) -> Column:
            m, s, e = F.get(marks, first), F.get(marks, first)["s"], F.get(marks, last)["e"]
            content = F.xxhash64(F.slice(hashes, s + 1, e - s + min_words), e - s)
            return F.struct(m["a"].alias("a"), content.alias("c"), s.alias("s"), e.alias("e"), places(m["a"], s, e, last - first + 1).alias("places"))

        return F.when(F.size(marks) > 0, _let(starts, lambda x: F.transform(x, lambda first, j: mark(first, F.coalesce(F.get(x, j + 1), F.size(marks)) - 1))))

    # one between two lower ones so near that each window with it has one of them is never selected
    def fewer(xs: Column) -> Column:
        def idle(x: Column, j: Column) -> Column:
            before, behind = F.get(xs, j - 1), F.get(xs, j + 1)
            return (before < x) & (behind < x) & (place(behind) - place(before) <= width)

        return F.filter(xs, lambda x, j: ~F.coalesce(idle(x, j), F.lit(False)))

    def of(xs: Column) -> Column:
        n, final = F.size(xs), F.size(hashes) - min_words

        # no more than ``width`` can lie in reach; mostly it is no more than NEAR
        def stretch(x: Column, j: Column) -> Column:
            at = place(x)
            left = F.when(place(F.get(xs, j - NEAR)) > at - width, j - width).otherwise(j - NEAR)
            right = F.when(place(F.get(xs, j + NEAR)) < at + width, j + width).otherwise(j + NEAR)
            before = F.array_max(F.filter(F.when(j > 0, F.sequence(F.greatest(left, F.lit(0)), j - 1)), lambda q: F.get(xs, q) < x))
            behind = F.array_min(F.filter(F.when(j < n - 1, F.sequence(j + 1, F.least(right, n - 1))), lambda q: F.get(xs, q) < x))
            s = F.greatest(at - (width - 1), F.lit(0), place(F.get(xs, before)) + 1)
            return F.struct(at.alias("at"), s.alias("s"), F.least(at, final, place(F.get(xs, behind)) - width).alias("e"))

        # windows between neighbouring candidates, in front of the first and behind the last
        def gap(s: Column, j: Column) -> Column:
            e = F.coalesce(place(F.get(xs, j)) - width, final)
            return F.when(s <= e, F.sequence(s, e)).otherwise(F.array().cast("array<int>"))

        def group(x: Column) -> Column:
            return F.struct(F.xxhash64(*(F.get(hashes, x["at"] + j) for j in range(k))).alias("a"), x["s"].alias("s"), x["e"].alias("e"))

        def least(w: Column) -> Column:
            return F.struct(F.array_min(F.transform(F.sequence(w, w + (width - 1)), value)).alias("a"), w.alias("s"), w.alias("e"))

        def held(v: Column, s: Column, e: Column, n: Column) -> Column:
            return F.size(F.filter(F.sequence(s, e + (width - 1)), lambda i: value(i) == v))

        chosen = F.transform(F.filter(F.transform(xs, stretch), lambda x: x["s"] <= x["e"]), group)
        alone = F.transform(F.flatten(F.transform(F.concat(F.array(F.lit(0)), F.transform(xs, lambda x: place(x) + 1)), gap)), least)
        none = F.array().cast("array<struct<a:bigint,c:bigint,s:int,e:int,places:int>>")
        return F.concat(F.coalesce(_let(chosen, lambda m: joined(m, lambda v, s, e, n: n)), none), F.coalesce(_let(alone, lambda m: joined(m, held)), none))

    def settle(xs: Column, rounds: int) -> Column:
        return _let(fewer(xs), lambda ys: settle(ys, rounds - 1)) if rounds else of(xs)

    candidates = F.filter(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: value(i) <= low)
    return _let(F.transform(candidates, packed), lambda xs: settle(xs, ROUNDS))


def _windows(hashes: Column, marks: Column, min_words: int) -> Column:
    """Place, hash g and least group a of each window of ``marks``; only their windows are hashed."""
    k = min(RADIX, min_words)

    def of(groups: Column) -> Column:
        def window(at: Column) -> Column:
            return F.xxhash64(*(F.get(groups, at + p) for p in _ends(min_words, k)))

        return F.flatten(F.transform(marks, lambda r: F.transform(F.sequence(r["s"], r["e"]), lambda at: F.struct(at.alias("at"), window(at).alias("g"), r["a"].alias("a")))))

    return _over(hashes, k, F.xxhash64, of)


def _spans(runs: Column, min_words: int) -> Column:
    """First and last word of each run of neighbouring windows, which come as runs s to e that don't overlap."""

    def of(r: Column) -> Column:
        first = F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["e"] != x["s"] - 1))
        last = F.filter(r, lambda x, i: (i == F.size(r) - 1) | (F.get(r, i + 1)["s"] != x["e"] + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a["s"].alias("s"), (b["e"] + (min_words - 1)).alias("e")))

    return _let(F.array_sort(runs), of)


def _key(docs: DataFrame, id_col: str) -> Column:
    """The identifier without nulls, in its order: a whole number, or the text of any other one; null is below all."""
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    return F.coalesce(F.concat(F.lit("1"), F.col(id_col).cast("string")), F.lit("0"))


def _among(rows: DataFrame, hash_col: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether a row's hash may be one of those of ``keys``; never false for one that is.

    The bits of SLOTS slots are broadcast, 4 kB for 32,768 of them, however many keys there are. So rows without a
    partner needn't be shuffled with their texts. Where keys fill the slots, more rows pass and nothing else changes.
    """
    slot = F.pmod(F.col(hash_col), F.lit(SLOTS)) + 1
    b, bits = unused([*rows.columns, name], "_lf_bucket", "_lf_bits")
    dealt = keys.select(F.bitmap_bucket_number(F.pmod(F.col("h"), F.lit(SLOTS)) + 1).alias(b), F.bitmap_bit_position(F.pmod(F.col("h"), F.lit(SLOTS)) + 1).alias("at")).repartition(b)
    maps = dealt.groupBy(b).agg(F.bitmap_construct_agg("at").alias(bits))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << j) for j in range(8))), (at % 8 + 1).cast("int"))) != 0, F.lit(False))
    return rows.withColumn(b, F.bitmap_bucket_number(slot)).join(F.broadcast(maps), b, "left").withColumn(name, held).drop(b, bits)


def repeated_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, h (identifier, null as a number below all, and text hash) and gone (first and last word of passages to delete) of each document with repeats.

    1. In each text every window of ``min_words`` words selects the least hash of the groups of words in it. Equal
       windows select the same, so a window whose least hash is at one place only can't be part of a repeat and goes
       (neighbours that select one hash at several places, as in a text that repeats itself at once, stay).
    2. Neighbouring windows with one selection are a stretch. A stretch with an earlier place is a repeat as a whole.
       It can't hold the first place of a window, so only the windows of first stretches go on.
    3. Those join the first place, by (identifier, text hash, word), of a window of equal content.
    4. A passage is a run of neighbouring windows that have an earlier place. Two texts that share a run of
       ``min_words`` words or more share each window of it: no run is missed, wherever lines begin and end.

    The first place of a content is the least one, so a link is one row however often the content occurs. Rows
    that agree in identifier and text are one document. Two independent hashes of 64 bits tell windows apart.
    """
    rows = docs.select(_key(docs, id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).select("i", F.xxhash64("t").alias("h"), "t")

    def long_enough(hashes: Column) -> Column:
        return F.when(F.size(hashes) >= min_words, _marks(hashes, min_words))

    steps = Steps(docs.sparkSession)
    marks = steps.stash(rows.filter(F.length("t") >= 2 * min_words - 1).select("i", "h", F.explode(_let(_words(F.col("t")), long_enough)).alias("x")).select("i", "h", "x.*"), "lines-marks")
    again = marks.groupBy("a").agg(F.sum("places").alias("n")).filter("n > 1").select("a")
    here = F.struct("i", "h", "s", "e").alias("src")
    stretches = steps.stash(marks.join(again, "a", "left_semi"), "lines-again")
    steps.drop(marks)
    firsts = steps.stash(stretches.groupBy("a", "c").agg(F.min(here).alias("src"), F.count(F.lit(1)).alias("n"), F.max("places").alias("places")), "lines-first")
    copies = stretches.join(firsts.filter("n > 1").select("a", "c", "src"), ["a", "c"]).filter(F.struct("i", "h", "s", "e") != F.col("src"))
    mixed = firsts.groupBy("a").agg(F.sum("places").alias("n")).filter("n > 1").select("a")
    held = steps.stash(firsts.join(mixed, "a", "left_semi").select("src.*", "a").groupBy("i", "h").agg(F.collect_list(F.struct("a", "s", "e")).alias("marks")), "lines-held")
    some = _among(rows, "h", held, "maybe").filter("maybe").drop("maybe")
    windows = some.join(held, ["i", "h"]).select("i", "h", F.explode(_let(_words(F.col("t")), lambda w: _windows(w, F.col("marks"), min_words))).alias("x"))
    kept = steps.stash(windows.select("i", "h", "x.*"), "lines-windows")
    steps.drop(held)
    first = kept.groupBy("g", "a").agg(F.min(F.struct("i", "h", "at")).alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "a", "src")
    later = kept.join(first, ["g", "a"]).filter(F.struct("i", "h", "at") != F.col("src"))
    gone = copies.select("i", "h", "s", "e").union(later.select("i", "h", F.col("at").alias("s"), F.col("at").alias("e")))
    return steps.keep(gone.groupBy("i", "h").agg(_spans(F.collect_set(F.struct("s", "e")), min_words).alias("gone")), "lines-gone")


def _without(text: Column, gone: Column) -> Column:
    """n (lines that lost words) and t (the text without the words of ``gone``)."""
    lead = F.regexp_extract(text, rf"\A{_GAP}*", 0)
    # a word with the white space behind it; k in front says that it stays, d stands for a word that goes
    pieces = F.regexp_extract_all(text, F.lit(rf"[^ \t\n\x0B\f\r]+{_GAP}*"), F.lit(0))
    word = F.lit(r"[^ \t\n\x0B\f\r]+")

    def part(p: Column, first: Column, end: Column, mark: str) -> Column:
        held = F.array_join(F.slice(p, first + 1, F.greatest(end - first, F.lit(0))), "")
        return F.regexp_replace(held, word, F.lit(mark))

    def marked(p: Column) -> Column:
        def span(r: Column, j: Column) -> Column:
            before = F.when(j == 0, F.lit(0)).otherwise(F.get(gone, j - 1)["e"] + 1)
            return F.concat(part(p, before, r["s"], "k$0"), part(p, F.greatest(before, r["s"]), r["e"] + 1, "d"))

        return F.concat(lead, F.array_join(F.transform(gone, span), ""), part(p, F.element_at(gone, -1)["e"] + 1, F.size(p), "k$0"))

    cut, stays = _START + "d", _START + "k"

    def rest(unit: Column) -> Column:
        tail = F.regexp_replace(unit, rf"{_BLANK}+d(?:{_BLANK}+d)*+{_BLANK}*(?=\n|\z)", "")
        return F.regexp_replace(F.when(unit.rlike(cut), F.regexp_replace(tail, rf"{cut}{_BLANK}*", "")).otherwise(unit), stays, "")

    def of(units: Column) -> Column:
        left = F.filter(units, lambda u: u.rlike(stays) | ~u.rlike(cut))
        return F.struct(F.size(F.filter(units, lambda u: u.rlike(cut))).alias("n"), F.array_join(F.transform(left, rest), "\n").alias("t"))

    return _let(_let(pieces, lambda p: _units(marked(p))), of)


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of each row, the text without later repeated passages of ``min_words`` words or more, n_lines, and n_removed (lines that lost words).

    Words are compared; lines and white space don't matter. A passage is deleted where an equal one comes earlier, in
    another document (by identifier, then text hash) or the same one: whole lines with their line feed, of a line that
    is repeated in part just those words. Texts without such passages stay as they are, null too; a text may become
    empty. Identifiers that are no whole numbers go by their text. Rows that agree in identifier and text are one document, and keep the same. The last two columns are called
    ``names``; other columns of these names are replaced. An empty table gives an empty result.
    """
    i, h, cut_out, new, maybe = unused([*docs.columns, *names], "_lf_i", "_lf_h", "_lf_gone", "_lf_text", "_lf_maybe")
    found = repeated_passages(docs, min_words, id_col, text_col)
    gone = found.select(F.col("i").alias(i), F.col("h").alias(h), F.col("gone").alias(cut_out))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = _among(docs.withColumns({i: _key(docs, id_col), h: F.xxhash64(text)}), h, found, maybe)
    others = [c for c in docs.columns if c not in (*names, text_col)]
    lines = F.when(F.trim(text, F.lit(SPACE)) == "", F.lit(0)).otherwise(F.size(_units(text))).cast("long").alias(names[0])
    old = F.struct(lines, F.lit(0).cast("long").alias(names[1]), F.col(text_col).cast("string").alias(new))
    # texts that go as a whole begin with a word and have no other part
    whole = (F.size(cut_out) == 1) & (F.get(cut_out, F.lit(0))["s"] == 0) & ~text.rlike(rf"\A{_GAP}") & (F.get(cut_out, F.lit(0))["e"] == F.size(_split(text)) - 1)
    emptied = F.struct(lines, lines.alias(names[1]), F.lit("").alias(new))
    cut = _let(_without(text, F.col(cut_out)), lambda x: F.struct(lines, x["n"].cast("long").alias(names[1]), x["t"].alias(new)))

    # a generator computes its rows once, however often their columns are used
    def made(part: DataFrame, row: Column) -> DataFrame:
        out = part.select(*[F.col(f"`{c}`") for c in others], F.inline(F.array(row)))
        return out.select(*[F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in names], *names)

    touched = rows.filter(maybe).join(gone, [i, h], "left")
    return made(rows.filter(~F.col(maybe)), old).union(made(touched, F.when(F.col(cut_out).isNull(), old).when(whole, emptied).otherwise(cut)))
