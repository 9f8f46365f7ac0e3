"""Operator 8: quality rules with thresholds adapted per language and source.

Features are computed once per document. A sketch of a feature is a histogram over bins of one relative width (1 %,
as in DDSketch): counts of bins add up exactly, in any order, so partial sketches merge across tasks, groups and runs to the
same result, and a source with a third of all rows is no hot task. Quantiles are read off the sketches of each
(lang, source), each language and all, and documents outside the fences of their group are rejected after a join with the
fences. A fence is the group's median and REACH times the distance from the lower quartile to it, which junk in under half
of a group can't move far. Quantiles of a group are drawn to those of its language, and these to those over all, as if by
PRIOR further rows. LIMITS holds what is left of fixed values: a least spread, as most groups have quartiles of 0, and a
highest fence for groups that are junk by more than half.

Defined results: null text has no words and fails the base rules; null lang or source is a
group of its own; repeated rows are judged alike; a text of any length is read whole; an empty table gives an empty result;
only text, lang and source are read, and the caller's columns, whatever their names, come through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, stage, words

#: Feature -> (least distance from quartile to median, highest fence). A fence is at q50 + REACH * (q50 - q25).
LIMITS = {"symbol_ratio": (0.0075, 0.20), "dup_line_ratio": (0.04, 0.60), "long_word": (0.2, 20.0)}
REACH = 8.0
#: Rows of the wider group that count beside a group's own.
PRIOR = 20.0
#: Ratio of a bin's bounds; values up to the least one share the bin of zero.
GROWTH = 1.02
LEAST = 1e-9
ZERO = -(1 << 20)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(arr: Column) -> Column:
    """Words that lie in 5-word windows found twice or more in the text."""

    def windows(a: Column) -> Column:
        n = F.size(a) - 4
        return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.slice(a, i + 1, F.lit(5))))).otherwise(F.expr("array()").cast("array<bigint>"))

    def covered(h: Column) -> Column:
        # (hash, position) sorted: neighbours with equal hashes are repeats; then lengths of merged spans.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("p"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, j: F.get(s, j)["h"] == x["h"]
            hit = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | ((i + 1 < n) & F.coalesce(same(x, i + 1), F.lit(False))))
            return F.sort_array(F.transform(hit, lambda x: x["p"]))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, positions), total)

    return let(let(F.transform(arr, lambda w: F.xxhash64(w)), windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of keep), lang, source and the five measures of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    arr = words(F.col("text"))
    return docs.select(
        packed(docs, keep),
        "lang",
        "source",
        let(arr, lambda a: F.struct(F.size(a).cast("long").alias("n_words"), F.aggregate(a, F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"), _repeat_words(a).alias("n_repeat_words"))).alias("m"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        let(lines, lambda a: F.size(a)).cast("long").alias("lines"),
    ).select("row", "lang", "source", "m.*", "n_symbols", "n_dup_lines", "lines")


def _features(m: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return m.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("lines"), F.lit(1)).cast("double"),
        "long_word": F.col("word_chars") / n,
    })


def sketches(features: DataFrame) -> DataFrame:
    """lang, source, feature, bin, c: the histograms of every (lang, source), combined before the shuffle."""
    place = lambda c: F.when(F.col(c) > LEAST, F.ceil(F.log(F.col(c)) / math.log(GROWTH)).cast("int")).otherwise(F.lit(ZERO))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("bin")) for c in LIMITS])).alias("x")
    return features.filter(~F.col("base_failed")).select("lang", "source", each).groupBy("lang", "source", "x.feature", "x.bin").agg(F.count("*").alias("c"))


def quantiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and for each feature its lower quartile and median, from sketches: rows of keys, feature, bin, c."""
    bins = merged.groupBy(*keys, "feature", "bin").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(*keys, "feature")
    upto = F.sum("c").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = bins.select(*keys, "feature", "bin", upto.alias("upto"), F.sum("c").over(whole).alias("n"))
    middle = lambda b: F.when(b > ZERO, F.lit(2 / (1 + GROWTH)) * F.pow(F.lit(GROWTH), b)).otherwise(0.0)
    at = lambda c, q: middle(F.min(F.when((F.col("feature") == c) & (F.col("upto") >= q * F.col("n")), F.col("bin"))))
    return summed.groupBy(*keys).agg(F.max("n").alias("n"), *[F.array(at(c, 0.25), at(c, 0.5)).alias(c) for c in LIMITS])


def fences(features: DataFrame) -> DataFrame:
    """One row per (lang, source): the upper fence of each feature."""
    every = stage(sketches(features), "sketches")
    named = lambda d, p: d.withColumnsRenamed({c: f"{p}_{c}" for c in ("n", *LIMITS)})
    own = named(quantiles(every, ["lang", "source"]), "own")
    lang = named(quantiles(every, ["lang"]), "lang").withColumnRenamed("lang", "of_lang")
    pool = quantiles(every, []).first()  # one row
    drawn = lambda q, n, wider: (q * n + wider * PRIOR) / (n + PRIOR)

    def fence(c: str) -> Column:
        low, mid = (drawn(F.col(f"own_{c}")[i], F.col("own_n"), drawn(F.col(f"lang_{c}")[i], F.col("lang_n"), F.lit(pool[c][i]).cast("double"))) for i in (0, 1))
        spread, highest = LIMITS[c]
        return F.least(mid + REACH * F.greatest(mid - low, F.lit(spread)), F.lit(highest)).alias(f"most_{c}")

    return own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang"))).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *map(fence, LIMITS))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of keep), lang, source, measures, base_failed and kept."""
    f = _features(stage(measure(docs, keep), "quality"))
    limits = stage(fences(f), "fences")
    out = f.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    ok = F.lit(True)
    for c in LIMITS:
        ok = ok & F.coalesce(F.col(c) <= F.col(f"most_{c}"), F.lit(False))
    return out.select("row", "lang", "source", *MEASURES, "base_failed", (~F.col("base_failed") & ok).alias("kept"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return judge(docs, docs.columns).filter("kept").select("row.*")
