"""Quality rules as weak supervision, with DataFrame functions only.

Base measures of each whole text are computed inside its row (no shuffle of words). Rules vote good, bad or
abstain on them; expectation-maximisation over the counted vote patterns of all documents estimates the rules'
accuracies and the share of good documents; the posterior replaces all-must-pass filtering.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for the row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each element and the one ``step`` places on."""
    n = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i")))
        before = F.zip_with(s, F.concat(none, F.slice(s, F.lit(1), n - 1)), lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), (a["h"] == b["h"]).alias("same")))
        both = F.zip_with(before, F.concat(F.slice(s, F.lit(2), n - 1), none), lambda a, b: F.struct(a["i"].alias("i"), (F.coalesce(a["same"], F.lit(False)) | F.coalesce(a["h"] == b["h"], F.lit(False))).alias("same")))
        return F.array_sort(F.transform(F.filter(both, lambda x: x["same"]), lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
    return F.aggregate(_let(by_hash, repeated), start, step, lambda acc: acc["n"])


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows that are found twice or more in the text, the first one included."""

    def of(hashes: Column) -> Column:
        eight = _let(_let(_pairs(hashes, 1), lambda two: _pairs(two, 2)), lambda four: _pairs(four, 4))
        return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(eight, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: the identifier, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and what the rules need besides.

    Null texts count as empty; an empty text has no words and fails the base. Work and memory of a row are
    in proportion to its text (times the logarithm of its words where windows repeat); nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    rows = rows.select(
        "_id",
        "_t",
        F.filter(F.split("_t", r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("_l"),
        *[F.length(F.replace(F.col("_t"), F.lit(c), F.lit(""))).alias(f"_s{i}") for i, c in enumerate(SYMBOLS)],
        F.length("_t").alias("_n"),
    )
    long = lambda c: c.cast("long")
    first = rows.select(
        "_id",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        long(8 * F.col("_n") - sum((F.col(f"_s{i}") for i in range(len(SYMBOLS))), F.lit(0))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        long(F.size("_l")).alias("n_lines"),
        long(F.size(F.array_distinct("_w"))).alias("n_distinct_words"),
        long(F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))).alias("n_exclaims"),
        F.when(F.col("_t") == F.upper("_t"), F.lit(True)).otherwise(False).alias("all_upper"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return first.withColumn("base_failed", failed).withColumnRenamed("_id", id_col)


def _band(x: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 abstains. Thresholds are ratios of the measures."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda c: F.col(c) / n
    mean = per("word_chars")
    return {
        "length": _band(n, n >= 50, n < 20),
        "symbols": _band(n, per("n_symbols") < 0.02, per("n_symbols") > 0.1),
        "symbol_chars": _band(n, F.col("n_symbols") * 200 < F.col("word_chars"), F.col("n_symbols") * 50 > F.col("word_chars")),
        "symbol_lines": _band(n, F.col("n_symbols") < F.col("n_lines"), F.col("n_symbols") > F.col("n_lines") * 2),
        "repeats": _band(n, per("n_repeat_words") < 0.1, per("n_repeat_words") > 0.3),
        "lines": _band(n, F.col("n_dup_lines") * 10 < F.col("n_lines"), F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "word_length": _band(mean, (mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 15)),
        "variety": _band(n, F.col("n_distinct_words") * 5 > n * F.when(n > 400, 0.5).otherwise(1.5), F.col("n_distinct_words") * 20 < n),
        "shouting": _band(n, (per("n_exclaims") < 0.05) & ~F.col("all_upper"), (per("n_exclaims") > 0.3) | (F.col("all_upper") & (n >= 20))),
    }


def fit_accuracies(counted: DataFrame, names: list[str], rounds: int = 30, prior: float = 0.8, good: float = 0.999, bad: float = 0.3) -> dict:
    """Expectation-maximisation over vote patterns (a column for each rule and ``n`` documents).

    A rule has two accuracies: how often it votes good on good documents and bad on bad ones, of those on
    which it doesn't abstain; abstentions say nothing. ``good`` and ``bad`` are the first guesses: a rule seldom
    fires on good text, and each kind of bad text sets off some rules only. Patterns are at most three to the
    power of the rules, whatever the number of documents, so they fit one row; all rounds are one fold there.
    Half a vote each way is added, and a rule stays better than chance, so the classes can't swap. Without
    documents the first guesses stay.
    """
    d = lambda x: F.lit(float(x))
    guess = F.struct(d(prior).alias("prior"), F.array(*[d(good)] * len(names)).alias("good"), F.array(*[d(bad)] * len(names)).alias("bad"))

    def weighed(m: Column) -> Column:
        """votes, n and posterior of each pattern under the model."""
        weights = F.zip_with(m["good"], m["bad"], lambda g, b: F.struct(F.log(g / (1 - b)).alias("g"), F.log((1 - g) / b).alias("b")))

        def of(w: Column) -> Column:
            def odds(x: Column) -> Column:
                each = F.zip_with(x["v"], w, lambda v, u: F.when(v == 1, u["g"]).when(v == -1, u["b"]).otherwise(d(0)))
                return F.aggregate(each, F.log(m["prior"] / (1 - m["prior"])), lambda acc, y: acc + y)

            return F.transform(F.col("patterns"), lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (1 / (1 + F.exp(-odds(x)))).alias("p")))

        return _let(weights, of)

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, d(0), lambda acc, x: acc + value(x))

    def better(rows: Column) -> Column:
        on = lambda x, k, c, y: F.when(c(F.get(x["v"], k)), y).otherwise(d(0))
        share = lambda k, c, y: (total(rows, lambda x: on(x, k, c, y(x))) + 0.5) / (total(rows, lambda x: on(x, k, lambda v: v != 0, y(x))) + 1)
        right = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.least(d(0.9999), F.greatest(d(0.5), share(k, lambda v: v == 1, lambda x: x["n"] * x["p"]))))
        wrong = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: share(k, lambda v: v == -1, lambda x: x["n"] * (1 - x["p"])))
        bound = lambda g: F.zip_with(wrong, g, lambda b, a: F.least(d(0.9999), F.greatest(1.02 * (1 - a), b)))
        p = F.least(d(0.99), F.greatest(d(0.01), total(rows, lambda x: x["n"] * x["p"]) / total(rows, lambda x: x["n"])))
        return _let(right, lambda g: F.struct(p.alias("prior"), g.alias("good"), bound(g).alias("bad")))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), guess, lambda m, _: _let(weighed(m), better))
    one = counted.agg(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n").cast("double").alias("n"))).alias("patterns"))
    m = one.select(F.when(F.size("patterns") == 0, guess).otherwise(fold).alias("m")).first()["m"]
    return {"prior": m["prior"], "good": dict(zip(names, m["good"], strict=True)), "bad": dict(zip(names, m["bad"], strict=True))}


def posterior(model: dict) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for k, g in model["good"].items():
        b = model["bad"][k]
        odds = odds + F.when(F.col(k) == 1, F.lit(math.log(g / (1 - b)))).when(F.col(k) == -1, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def quality_rules(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base measures, base_failed, kept, quality (posterior), other measures and votes of each row.

    kept is false where base_failed is true, else quality >= threshold. The measures are written to the shared
    folder once, narrow rows without texts; patterns are counted over all documents with a map-side part.
    Repeated rows count as often as they occur.
    """
    rules = votes()
    scored = stash(measures(docs, id_col, text_col).withColumns({f"vote_{k}": c for k, c in rules.items()}), "rules")
    names = [f"vote_{k}" for k in rules]
    counted = scored.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    model = fit_accuracies(counted, names)
    quality = posterior(model)
    kept = (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept")
    base = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return scored.withColumn("quality", quality).select(*base, kept, "quality", *[c for c in scored.columns if c not in base])
