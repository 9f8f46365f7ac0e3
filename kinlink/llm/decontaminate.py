"""Operator 2: benchmark decontamination by a prefix-filtered set join.

Windows of 10 consecutive item words are the sets to be contained. The words of the benchmark
are ordered by their document frequency over all documents, rarest first. A containment of 1
needs only the first word of that order (the necessary prefix): documents are probed by it,
window offset and length bound the place, and a candidate counts only if all words of the
window equal the document's words there.

The benchmark is held in parts of at most PART_BYTES of text. One part at a time is sent to the executors, counted, probed
and written, and its broadcast dropped before the next; a benchmark of more parts takes as many passes over the documents. Each part's
hits are kept by a 128-bit key of the document's id and text and met again in a join. Nothing of the documents is collected but one count per benchmark word.

Defined results: null text has no words (0, 0, 0, hash of "", false); items with null id or
without words are no items; repeated rows give repeated results; equal or null doc_ids of different texts stay apart; a text of any
length is probed whole; an empty benchmark leaves all clean; the caller's columns, whatever their names, come through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, row_key, stage

WINDOW = 10
PART_BYTES = 16 << 20
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[str]:
    return WORDS.findall(_lower(text)) if text else []


def _lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _counts(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = vocabulary.value, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(known.intersection(WORDS.findall(_lower(t))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def rarity(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """Document frequency, over all documents, of the words of a benchmark part."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))
    rows = docs.filter("text is not null").select("text").mapInArrow(_counts(sent), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    return {r.word: r.n for r in rows}


def build_index(items: list[tuple[str, list[str]]], frequency: dict[str, int]) -> dict:
    """First word -> {(offset in the window, length): {window: item ids}}."""
    index: dict = {}
    for item, w in items:
        size = min(WINDOW, len(w))
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            at = min(range(size), key=lambda k: (frequency.get(window[k], 0), window[k], k))
            index.setdefault(window[at], {}).setdefault((at, size), {}).setdefault(window, set()).add(item)
    return index


def find(words: list[str], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit spans and ids of the items that occur."""
    anchors = index.keys() & set(words)
    if not anchors:
        return [], set()
    spans, items, n = [], set(), len(words)
    for i, word in enumerate(words):
        if word in anchors:
            for (offset, size), windows in index[word].items():
                a = i - offset
                if a >= 0 and a + size <= n and (found := windows.get(tuple(words[a : a + size]))):
                    spans.append((a, a + size))
                    items |= found
    merged: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
        else:
            merged.append((a, z))
    return merged, items


_FOUND = "n_words long, spans array<struct<a:bigint,z:bigint>>, items array<string>"


def _probe(index, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, items = [], [], []
            for t in b.column("text").to_pylist():
                w = WORDS.findall(_lower(t)) if t else []
                s, i = find(w, index.value)
                sizes.append(len(w))
                spans.append([{"a": x, "z": y} for x, y in s])
                items.append(sorted(i))
            kept = [k for k, n in enumerate(b.schema.names) if n != "text"]
            out = pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], [*(b.schema.names[k] for k in kept), "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

    return run


def _probed(source: DataFrame, part: list[tuple[str, list[str]]], docs: DataFrame, only_hits: bool) -> tuple[DataFrame, object]:
    """source (columns, text) with the part's hits, and the broadcast that it reads."""
    sent = docs.sparkSession.sparkContext.broadcast(build_index(part, rarity(docs, {w for _, ws in part for w in ws}) if part else {}))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text"]
    return source.mapInArrow(_probe(sent, only_hits), ", ".join([*kinds, _FOUND])), sent


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[str, list[str]]]]:
    part, size = [], 0
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct()
    for item, text in rows.toLocalIterator():
        if w := item_words(text):
            part.append((item, w))
            size += len(text)
            if size >= PART_BYTES:
                yield part
                part, size = [], 0
    if part:
        yield part


def _merged(spans):
    """Overlapping and adjacent spans joined."""
    none = F.expr("cast(array() as array<struct<a:bigint,z:bigint>>)")

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.array(F.struct(last["a"].alias("a"), F.greatest(last["z"], x["z"]).alias("z")))
        return F.when(last["z"] >= x["a"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, add)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of keep), n_words, spans (merged hit spans in words) and items (sorted ids) of every document."""
    keep = ["doc_id"] if keep is None else keep
    parts = _parts(benchmark)
    part, ahead = next(parts, []), next(parts, None)
    source = docs.select(packed(docs, keep), "text")
    if ahead is None:
        return _probed(source, part, docs, False)[0]
    # Hits of every part but the last, by the document's content: equal rows have equal hits.
    key = row_key("doc_id", "text").alias("key")
    hits = []
    while ahead is not None:
        found, sent = _probed(docs.select(key, "text"), part, docs, True)
        hits.append(stage(found.dropDuplicates(["key"]).select("key", "spans", "items"), "hits"))
        sent.destroy()
        part, ahead = ahead, next(parts, None)
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    every = every.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("others"))
    last = _probed(docs.select(packed(docs, keep), key, "text"), part, docs, False)[0].join(every, "key", "left")
    both = lambda c, d: F.when(F.col(d).isNull(), F.col(c)).otherwise(F.concat(c, d))
    return last.select("row", "n_words", _merged(both("spans", "more")).alias("spans"), F.array_sort(F.array_distinct(both("items", "others"))).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["z"] - s["a"])
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    return contamination(docs, benchmark, docs.columns).filter(F.size("spans") == 0).select("row.*")
