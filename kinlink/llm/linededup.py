"""Operator 6: line dedup over overlapping windows of three lines.

Lines are the \\n-split lines that hold a character other than white space, compared without white space
at their ends. Every three consecutive lines are hashed (two 64-bit hashes). A window found more
than once in the whole table keeps its first occurrence, by (doc_id, hash of the text, line); the
others are removed: a line goes if any later occurrence covers it, and overlapping occurrences are merged.

The first occurrence is a minimum, combined before the shuffle; occurrences meet it in a join
whose other side has one row per window, so a window that fills a third of all rows can be split. Lines are
taken out by taking the removed numbers from all numbers by hash, so a text of very many lines takes time in proportion.

Defined results: null and blank texts, and those of under three lines, stay as they are (null: null);
rows equal in doc_id and text are one document and get the same result, whatever their number;
null doc_id comes first; a text of any length is read whole; an empty table gives an empty result;
the caller's columns come through untouched, and the two counts get underscores behind their names where the caller has such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, let, packed, row_key, stage

WINDOW = 3
BLANKS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text):
    """Structs of a line's number among all lines and its hash, without blank lines."""
    all_lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, BLANKS, "").alias("x")))
    return F.transform(F.filter(all_lines, lambda s: s["x"] != ""), lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(s["x"], F.lit(7)).alias("g")))


def windows(docs: DataFrame) -> DataFrame:
    """key, doc_id, h, g, at: every window of WINDOW lines and the number of its first line."""
    pick = lambda a, i, f: [F.get(a, i + j)[f] for j in range(WINDOW)]
    found = let(_lines(F.col("text")), lambda a: F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - (WINDOW - 1), F.lit(0))), lambda s, i: F.struct(F.xxhash64(*pick(a, i, "h")).alias("h"), F.xxhash64(*pick(a, i, "g")).alias("g"), F.array(*pick(a, i, "i")).alias("lines"))))
    d = docs.filter("text is not null").select("doc_id", row_key("doc_id", "text").alias("key"), found.alias("w"))
    return d.select("doc_id", "key", F.explode("w").alias("w")).select("doc_id", "key", "w.*")


def removed_lines(docs: DataFrame) -> DataFrame:
    """key -> sorted numbers of the lines that later occurrences cover."""
    w = stage(windows(docs), "windows")
    place = F.struct("doc_id", "key", F.col("lines")[0].alias("at"))
    first = w.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last or first is null")
    later = w.join(first.select("h", "g", "first"), ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    return later.select("key", F.explode("lines").alias("line")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text freed of repeated passages, n_lines (before) and n_removed."""
    gone = stage(removed_lines(docs), "gone").withColumnRenamed("key", "gone_key")
    # A merge join at every size: the table of removed lines grows with the documents.
    d = docs.select(packed(docs), docs["text"].alias("text"), row_key("doc_id", "text").alias("key")).join(gone.hint("merge"), F.col("key") == F.col("gone_key"), "left")
    lines = F.split("text", "\n")
    # Numbers of the lines that stay, joined by their places: array_except hashes, where a search in a list would not scale.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = let(lines, lambda a: F.array_join(F.transform(stay, lambda i: F.get(a, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    n_lines, n_removed = free("n_lines", docs.columns), free("n_removed", docs.columns)
    return d.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_removed))
