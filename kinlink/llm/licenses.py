"""Operator 1: license scans by patience alignment.

The words of a license text that are unique in it and in the document are anchors; the longest
increasing run of their places is kept, and the gaps between anchors are aligned again in the same way,
where more words are unique. Coverage is the share of the license's words that are aligned in a
window of the document; a license is found at a coverage of COVERAGE or more.

A copy is looked for around each place of a probe, one of the template's rarest words in the document. A probe that the
template holds once is an anchor itself, and the text between its neighbours of the same word is what is aligned to either side, so
copies that stand close, or back to back, don't hide each other's unique words; where that finds too little, as with a probe that
strays into a copy, the whole stretch of twice the template's length to either side is aligned. Of overlapping finds of one
license that of most aligned words, less the others between them, stays; a find is dropped for one of another license that overlaps it by half, with as many aligned words and more coverage.

Templates are parameters, given as text, and go to the executors once; they don't grow with the data.
Defined results: null and blank texts hold no license; each row is scanned alone, so repeated rows and ties
between templates give each its own result (sorted by place, then name); a text of any length is read whole; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEMPLATES

COVERAGE = 0.8
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def license_words(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second rises (patience piles)."""
    tops: list[int] = []
    last: list[int] = []
    back = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(last[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[k], last[k] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of a (template) and b (document), rising in both; no recursion, so any depth works."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        ours, theirs = Counter(a[i:n]), Counter(b[j:m])
        where = {w: k for k, w in enumerate(b[j:m], j) if theirs[w] == 1}
        pairs = longest_rising([(k, where[a[k]]) for k in range(i, n) if ours[a[k]] == 1 and a[k] in where])
        if not pairs:
            continue
        out += pairs
        edges = [(i - 1, j - 1), *pairs, (n, m)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False) if p + 1 < q and r + 1 < s]
    return sorted(out)


def _densest(pairs: list[tuple[int, int]], reach: int) -> tuple[int, int, int]:
    """Most pairs within reach words of the document, and its first and last of them: a pair far from its neighbours belongs to other text."""
    best, k = (0, 0, 0), 0
    for x in range(len(pairs)):
        while pairs[x][1] - pairs[k][1] >= reach:
            k += 1
        best = max(best, (x - k + 1, -pairs[k][1], pairs[x][1]))
    return best[0], -best[1], best[2]


def _around(t: list[str], need: Counter, words: list[str], at: int, lo: int, hi: int, j: int | None) -> tuple[int, int, int] | None:
    """Aligned words, start and end of a copy in words[lo:hi]; j: the place in the template that is bound to place at."""
    if sum((Counter(words[lo:hi]) & need).values()) < COVERAGE * len(t):
        return None
    if j is None:
        pairs = [(a, b + lo) for a, b in align(t, words[lo:hi])]
    else:
        pairs = [(a, b + lo) for a, b in align(t[:j], words[lo:at])] + [(j, at)] + [(a + j + 1, b + at + 1) for a, b in align(t[j + 1 :], words[at + 1 : hi])]
    n, first, last = _densest(pairs, 2 * len(t))
    return (n, first, last + 1) if n >= COVERAGE * len(t) else None


def copies(words: list[str], t: list[str], places: dict[str, list[int]]) -> list[tuple[int, int, int]]:
    """Aligned words, start and end of the copies of one template, which don't overlap. places: of the template's words in the document."""
    need = Counter(t)
    if sum(min(k, len(places.get(w, ()))) for w, k in need.items()) < COVERAGE * len(t):
        return []
    # Of any COVERAGE of the words some rarest ones must be there: their places are where a copy can lie.
    probes, left = [], len(t) - COVERAGE * len(t)
    for w in sorted(need, key=lambda w: (len(places.get(w, ())), w)):
        probes.append(w)
        left -= need[w]
        if left < 0:
            break
    found: list[tuple[int, int, int]] = []
    whole: list[tuple[int, int]] = []
    for w in probes:
        own = places.get(w, [])
        j = t.index(w) if need[w] == 1 else None
        for k, at in enumerate(own):
            if any(a <= at < z for a, z in whole):
                continue
            lo, hi = max(0, at - 2 * len(t)), min(len(words), at + 2 * len(t))
            got = None
            if j is not None:
                got = _around(t, need, words, at, max(lo, own[k - 1] + 1 if k else 0), min(hi, own[k + 1] if k + 1 < len(own) else hi), j)
            got = got or _around(t, need, words, at, lo, hi, None)
            if got:
                found.append(got)
                if got[0] == len(t) and 4 * (got[2] - got[1]) <= 5 * len(t):
                    whole.append(got[1:])
    out: list[tuple[int, int, int]] = []
    for n, a, z in sorted(set(found), key=lambda x: (x[2] - x[1] - 2 * x[0], x[1])):
        if all(z <= b or y <= a for _, b, y in out):
            out.append((n, a, z))
    return out


def scan(words: list[str], templates: dict[str, list[str]]) -> list[tuple[int, int, str, float]]:
    """First word, end, name and coverage of each license in a document's words."""
    places: dict[str, list[int]] = {}
    vocabulary = {w for t in templates.values() for w in t}
    for i, w in enumerate(words):
        if w in vocabulary:
            places.setdefault(w, []).append(i)
    every = [(a, z, name, n / len(t), n) for name, t in templates.items() for n, a, z in copies(words, t, places)]
    better = lambda x, y: y[3] > x[3] and y[4] >= x[4] and 2 * (min(x[1], y[1]) - max(x[0], y[0])) >= x[1] - x[0]
    return sorted(x[:4] for x in every if not any(better(x, y) for y in every))


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = {k: license_words(v) for k, v in sent.items()}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))
        for b in batches:
            found, sizes = [], []
            for t in b.column("text").to_pylist():
                w = license_words(t) if t else []
                sizes.append(len(w))
                found.append([dict(zip(("start", "end", "license", "coverage"), x, strict=True)) for x in scan(w, templates)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "found"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words and found: array of (start, end, license, coverage) in words, of every document."""
    d = docs.select("doc_id", "text").withColumn("doc_id", docs["doc_id"].cast("long"))
    return d.mapInArrow(_scan(templates or TEMPLATES), "doc_id long, n_words long, found array<struct<start:bigint,end:bigint,license:string,coverage:double>>")
