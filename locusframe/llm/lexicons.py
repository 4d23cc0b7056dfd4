"""I-Match fingerprints: terms of a band of document frequencies, sorted and hashed by randomised subsets of the lexicon.

The lexicon has the terms whose inverse document frequency, as a share of the greatest one, lies within BAND. It is cut at
random into SUBSETS parts by the hash of a term; thinner lexicons, each with a quarter of the terms of the one before, are cut
alike. A document has an entry for each subset that holds one of its terms: the hash of its sorted distinct terms there.
An entry stays the same if none of its terms changes, so of short texts the full lexicon tells how much of them is equal, of
long ones a thinner one. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps
from .merkle import numbered

#: Least and greatest inverse document frequency of a term of the lexicon, by the logarithm of the number of documents.
BAND = (0.1, 0.6)
#: Subsets of each lexicon, and lexicons, each with a quarter of the terms of the one before.
SUBSETS, LEXICONS = 32, 5
#: Terms of a lexicon that is broadcast, some 16 bytes each; a larger one is joined by its key.
MOST_TERMS = 2_000_000
#: An entry is a digit for its lexicon, a character of these for its subset and four hex digits of hash.
_NAMES, _ENTRY = "0123456789abcdefghijklmnopqrstuv", 6


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text, runs of letters and digits in lower case; none for null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(documents: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Terms (_h) of ``documents`` (_terms, an array of distinct hashes) within the band.

    Counted over all documents; partial counts are made before the shuffle. A term's inverse document frequency is ln(n / df) / ln(n).
    """
    n = documents.agg(F.count(F.lit(1)).alias("_all"))
    counts = documents.select(F.explode("_terms").alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_df"))
    share = F.log(F.col("_all") / F.col("_df")) / F.greatest(F.log("_all"), F.lit(1e-9))
    # one row on the other side
    return counts.join(F.broadcast(n)).filter(share.between(*band)).select("_h")


def entries(sorted_terms: Column) -> Column:
    """The fingerprint of sorted distinct terms of the lexicon.

    The subset of a term goes by its high bits, so terms of a subset lie side by side and each lexicon is one fold over
    them; the lexicons that have it go by its low bits.
    """
    subset = lambda x: F.shiftrightunsigned(x, 59).cast("int")

    def of(level: int) -> Column:
        mine = F.filter(sorted_terms, lambda x: x.bitwiseAND(F.lit(4**level - 1).cast("long")) == 0) if level else sorted_terms

        def closed(acc: Column) -> Column:
            entry = F.concat(F.lit(str(level)), F.substring(F.lit(_NAMES), acc["s"] + 1, F.lit(1)), F.lower(F.lpad(F.hex(F.pmod(acc["h"], F.lit(1 << 16))), 4, "0")))
            return F.when(acc["s"] < 0, acc["out"]).otherwise(F.concat(acc["out"], entry))

        def step(acc: Column, x: Column) -> Column:
            same = acc["s"] == subset(x)
            return F.struct(subset(x).alias("s"), F.when(same, F.xxhash64(acc["h"], x)).otherwise(F.xxhash64(x)).alias("h"), F.when(same, acc["out"]).otherwise(closed(acc)).alias("out"))

        return F.aggregate(mine, F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("h"), F.lit("").alias("out")), step, closed)

    return F.concat(*[of(k) for k in range(LEXICONS)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries (0 to 1) of two fingerprints.

    It is taken in the thinnest lexicon of which half of the subsets are there in one of them, else in the full one, over the
    subsets that are there in one of them. 1 for equal fingerprints.
    """
    cut = lambda fp: F.regexp_extract_all(fp, F.lit(f"(.{{{_ENTRY}}})"), F.lit(1))
    told = F.lit(0.0)
    for k in range(LEXICONS):
        x, y = (F.filter(cut(fp), lambda e: F.startswith(e, F.lit(str(k)))) for fp in (a, b))
        places = F.size(F.array_union(*[F.transform(some, lambda e: F.left(e, F.lit(2))) for some in (x, y)]))
        told = F.when(places >= (SUBSETS // 2 if k else 1), F.size(F.array_intersect(x, y)) / places).otherwise(told)
    return F.when(a == b, F.lit(1.0)).otherwise(told)


def _without_terms(text: Column) -> Column:
    """The entry of a text of which the lexicon has no term: 'z', and a hash of its sorted distinct terms."""
    return F.concat(F.lit("z"), F.lower(F.right(F.lpad(F.hex(F.xxhash64(F.array_sort(terms(text)))), 16, "0"), F.lit(_ENTRY - 1))))


def fingerprints(texts: DataFrame, key: str, columns: list[str], words: DataFrame) -> DataFrame:
    """``key`` and, for each of the text ``columns``, its fingerprint of the same name.

    Terms are looked up one by one and gathered again by key; rows that are dealt by key already stay where they
    are if the lexicon is broadcast.
    """
    tagged = lambda i, c: F.transform(terms(F.col(c)), lambda h: F.struct(F.lit(i).alias("i"), h.alias("_h")))
    each = F.explode(F.concat(*[tagged(i, c) for i, c in enumerate(columns)]))
    met = texts.select(key, each.alias("x")).select(key, "x.i", "x._h").join(words, "_h")
    of = lambda i: entries(F.array_sort(F.collect_set(F.when(F.col("i") == i, F.col("_h")))))
    return met.groupBy(key).agg(*[of(i).alias(c) for i, c in enumerate(columns)])


def match_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has the last half of its code points replaced by the first as many, or all, of the next document's in
    descending order of doc_id (equal ones by a hash of the text, nulls last); after the last comes the first, so a single
    document is its own next. A null text is empty, and an empty one has no terms. The fingerprint of a text without terms of
    the lexicon is a hash of all its terms. Equal rows are fingerprinted one by one. Other columns don't count.

    Texts are dealt out once, by row number; next documents send the characters that are asked for.
    """
    steps = Steps(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("_text"), F.length(text).cast("long").alias("_n"), F.xxhash64(text).alias("_hash"), F.lit("").alias("_all"), F.monotonically_increasing_id().alias("_row"))
    base = steps.stash(base, "match-texts")
    words = steps.stash(lexicon(base.select(terms(F.col("_text")).alias("_terms"))), "match-lexicon")
    if words.count() <= MOST_TERMS:
        words = F.broadcast(words)
    places = numbered(base.select("_all", "doc_id", "_hash", "_row", "_n").withColumnRenamed("_row", "_id").withColumnRenamed("_n", "_chars"), steps, "_all", ["doc_id", "_hash"], "match-places")
    places = steps.stash(places.select("doc_id", F.col("_id").alias("_row"), "_chars", "_at", F.pmod(F.col("_at") - 1, F.col("_n")).alias("_next")), "match-next")
    asked = places.select(F.col("_next").alias("_at"), F.col("_row").alias("_for"), F.floor(F.col("_chars") / 2).cast("int").alias("_half")).join(places.select("_at", "_row"), "_at").drop("_at")
    asked = steps.stash(asked, "match-asked")

    texts = base.select("_row", "_text")
    heads = texts.join(asked, "_row").select(F.col("_for").alias("_row"), "_half", F.left("_text", F.col("_half")).alias("_head"))
    edited = texts.join(heads, "_row").select("_row", "_text", F.concat(F.left("_text", F.length("_text") - F.col("_half")), "_head").alias("_edited"))
    found = fingerprints(edited, "_row", ["_text", "_edited"], words).toDF("_row", "_own", "_other")
    named = lambda fp, text: F.when(F.coalesce(F.col(fp), F.lit("")) == "", _without_terms(F.col(text))).otherwise(F.col(fp))
    made = edited.join(found, "_row", "left").select("_row", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), named("_own", "_text").alias("fingerprint"), named("_other", "_edited").alias("edited_fingerprint"))
    made = steps.stash(made, "match-made")
    steps.drop(base)
    after = made.select("_row", F.col("fingerprint").alias("_after")).join(asked.select("_row", "_for"), "_row").select(F.col("_for").alias("_row"), "_after")
    out = made.join(places.select("_row", "doc_id"), "_row").join(after, "_row")
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("_after"))}
    return steps.keep(out.withColumns(near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near), "match")
