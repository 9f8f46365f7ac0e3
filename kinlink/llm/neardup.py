"""Operator 10: near duplicates by BagMinHash over word 5-shingles.

Weighted elements are a text's shingles with their counts (lower case, words cut at white space;
a text of under five words is one shingle). The weight axis is discretised at integers and cut into
dyadic intervals [0,1), [1,2), [2,4), [4,8), ... Each (shingle, interval) has a Poisson process
of the interval's width as rate; its points fall on registers and, hierarchically, on a level inside the
interval, and count for weights above that level. A register keeps its first point, so two texts
agree in a register with the probability of their weighted Jaccard similarity. Only points before a
bound at which all registers are filled are made, so a long text costs little more than one hash per shingle.

Signatures are banded (BANDS x ROWS: a pair of similarity 0.8 is missed with probability 7e-5).
Equal texts are one node. In each bucket every member is compared with a leader, the member whose buckets
are the largest together (in a group of copies, that most like all the others); those that join no leader's class elect
further leaders (one, then 4, 16, 64, 256 and 1,024 at a time; in a bucket of at most SMALL all at once) among themselves until none is left, so a group
of copies does not yield all its pairs and no bucket is capped. The first round takes a third of the buckets, which
joins most of a group of copies before its members meet again in the others; the later rounds take all. Last, in every
bucket that still holds several classes, those outside its largest class are compared with all members of other classes,
also with those that had joined a leader, so no pair of a bucket is left out. Pairs count if the exact multiset overlap is at least 0.8; classes are the connected components.

Defined results: texts without words are in no class but their own; rows of equal doc_id and text are one node;
the class id is the smallest doc_id of a class (null doc_ids: null, only where all are null);
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, packed, stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Of REGISTERS' lowest bits, half in each of two longs; a pair of similarity 0.8 agrees in 108 on average, with a deviation of 3.3.
LIKELY = 93
U = np.uint64
#: Bits of a multiset's odd sketch, whose exclusive or never has more bits than two multisets have differences. Long texts with a
#: passage in common meet in buckets by the thousand and differ in hundreds of elements, which would fill 512 bits. The JVM compiles no
#: method of over 8,000 bytes; that of the join by these columns has 7,069.
ODD = 2048
#: Longs of a node that follow it into its buckets: two of the registers' lowest bits, the others of the odd sketch.
REGISTER_BITS, ODD_BITS = ["s0", "s1"], [f"w{i}" for i in range(ODD // 64)]
BITS = REGISTER_BITS + ODD_BITS
#: Buckets with so few members left are finished in one round: each is compared with the others.
SMALL = 8
#: Links whose components one task finds; more are labelled by joins, whose many small stages a driver would have to keep for few links.
FEW_LINKS = 200_000
#: Words whose hashes a Python worker holds.
HELD_WORDS = 1_000_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of SHINGLE words, with repeats."""
    h = hashes.astype(np.uint64)
    k = min(SHINGLE, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def _points(seed: np.ndarray, width: int, weight: np.ndarray, base: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and hashes of the points up to bound, of all elements' processes on [base, base + width)."""
    times, marks = [], []
    now, j = np.zeros(len(seed)), 0
    while len(seed):
        many = 1 if j == 0 else int(bound * width + 3 * (bound * width) ** 0.5 + 2)
        p = mix(mix(seed)[:, None] + (np.arange(j + 1, j + 1 + many, dtype=np.uint64) * U(0x9E3779B97F4A7C15))[None, :])
        t = now[:, None] + np.cumsum(-np.log(((p >> U(11)).astype(np.float64) + 1.0) * 2.0**-53), axis=1) / width
        q = mix(p)
        ok = t <= bound
        if width > 1:
            ok &= (base + (mix(q) % U(width)).astype(np.int64)) < weight[:, None]
        times.append(t[ok])
        marks.append(q[ok])
        on = t[:, -1] <= bound
        seed, weight, now, j = seed[on], weight[on], t[on, -1], j + many
    return np.concatenate(times or [np.zeros(0)]), np.concatenate(marks or [np.zeros(0, np.uint64)])


def signature(shingled: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """REGISTERS 64-bit values of a non-empty multiset."""
    seed, weight = np.unique(shingled, return_counts=True)
    bound = registers * (np.log(registers) + 2.5) / len(shingled)
    while True:
        times, marks = _points(seed, 1, weight, 0, bound)
        times, marks, base, k = [times], [marks], 1, 1
        while (more := weight > base).any():
            t, q = _points(mix(seed[more] + U(k)), base, weight[more], base, bound)
            times.append(t)
            marks.append(q)
            base, k = base * 2, k + 1
        t, q = np.concatenate(times), np.concatenate(marks)
        q = q[np.argsort(t, kind="stable")]
        at, first = np.unique(q % U(registers), return_index=True)
        if len(at) == registers:
            return q[first]
        bound *= 2


def bands(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + s[:, j])
    return out.view(np.int64)


def elements(shingled: np.ndarray) -> np.ndarray:
    """The multiset as a set: hashes of (shingle, number of the occurrence)."""
    h = np.sort(shingled)
    new = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def odd_sketch(els: np.ndarray) -> np.ndarray:
    """ODD bits as longs: of each bit, whether an odd number of elements falls on it."""
    return np.packbits((np.bincount((els.view(np.uint64) % U(ODD)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)).view(np.int64)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:z]


def _list_of(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


class _Hashes(dict):
    """64-bit hashes of words, made once for each word held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def _shingled(texts: pa.Array, held: _Hashes) -> Iterator[np.ndarray]:
    for text in texts:
        w = text.as_py().lower().encode().split()  # at U+0020 and U+0009 to U+000D
        yield shingles(np.fromiter(map(held.__getitem__, w), np.uint64, len(w)))


def _half(low: np.ndarray) -> np.ndarray:
    """Bits as one long for each row."""
    return (low << np.arange(low.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    held = _Hashes()
    for b in batches:
        sizes, sigs = [], []
        for s in _shingled(b.column("text"), held):
            sizes.append(len(s))
            sigs.append(signature(s) if len(s) else np.zeros(REGISTERS, np.uint64))
        low = np.array(sigs, np.uint64).reshape(-1, REGISTERS) >> U(63)
        sig = _list_of([bands(s) if n else np.zeros(0, np.int64) for n, s in zip(sizes, sigs, strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(sizes, pa.int64()), sig, pa.array(_half(low[:, ::2])), pa.array(_half(low[:, 1::2]))], ["doc_id", "node", "n", "bands", *REGISTER_BITS])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    held = _Hashes()
    for b in batches:
        els = [elements(s) for s in _shingled(b.column("text"), held)]
        odd = np.array([odd_sketch(e) for e in els], np.int64).reshape(-1, ODD // 64)
        yield pa.RecordBatch.from_arrays([b.column("node"), _list_of(els), *map(pa.array, odd.T.copy())], ["node", "els", *ODD_BITS])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, node, text: the key of a text is its digest."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return d.select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")


def crowded(nodes: DataFrame) -> DataFrame:
    """node, central, values, rep, n, REGISTER_BITS: the members of every bucket of two or more, with those buckets; central is their sizes together."""
    each = nodes.select("node", F.explode("bands").alias("value"))
    crowd = each.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    per_node = each.join(crowd, "value").groupBy("node").agg(F.sum("c").alias("central"), F.collect_list("value").alias("values"))
    return per_node.join(nodes.select("node", "rep", "n", *REGISTER_BITS), "node")


def elect(buckets: DataFrame, leaders: int) -> DataFrame:
    """value, leader, m, the leader's BITS, lc, leader_root: the most central members of each bucket, and all of a small one's."""
    top = F.max(F.struct("central", "node", "n", *BITS, "root")).alias("l")
    large = buckets.filter(F.col("size") > SMALL)
    if leaders == 1:
        lead = large.groupBy("value").agg(top).select("value", "l.*")
    else:
        lead = large.withColumn("place", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("central"), F.desc("node")))).filter(F.col("place") <= leaders)
    return _as_leaders(lead).union(_as_leaders(buckets.filter(F.col("size") <= SMALL)))


def _as_leaders(buckets: DataFrame) -> DataFrame:
    return buckets.select("value", F.col("node").alias("leader"), F.col("n").alias("m"), *[F.col(c).alias(f"l{c}") for c in BITS], F.col("central").alias("lc"), F.col("root").alias("leader_root"))


def mixed(buckets: DataFrame, roots: DataFrame, members: DataFrame, els: DataFrame) -> DataFrame:
    """value, node, root, central, n, BITS: the members of all buckets of several classes; central is 0 in a bucket's largest class and 1 in the others."""
    placed = stage(buckets.select("value", "node").join(roots, "node"), "placed")
    largest = placed.groupBy("value", "root").agg(F.count("*").alias("c")).groupBy("value").agg(F.max(F.struct("c", "root"))["root"].alias("largest"), F.count("*").alias("classes"))
    several = placed.join(largest.filter("classes > 1"), "value").select("node", "root", F.struct("value", (F.col("root") != F.col("largest")).cast("long").alias("central")).alias("at"))
    per_node = several.groupBy("node").agg(F.first("root").alias("root"), F.collect_list("at").alias("ats"))
    sketched = per_node.join(members.select("node", "n", *REGISTER_BITS), "node").join(els.select("node", *ODD_BITS), "node")
    out = stage(sketched.withColumn("at", F.explode("ats")).select("at.value", "node", "root", "at.central", "n", *BITS), "mixed")
    discard(placed)
    return out


def compare(buckets: DataFrame, lead: DataFrame, els: DataFrame) -> DataFrame:
    """a, b: the classes of every member and leader of a bucket that are similar."""
    after = (F.col("central") < F.col("lc")) | ((F.col("central") == F.col("lc")) & (F.col("node") < F.col("leader")))
    close = F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")
    apart = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"l{c}"))) for c in BITS]
    # Pairs whose registers agree far too seldom need no texts, nor those that differ in more elements than similar
    # texts can: that many bits at most are set; in long texts, which fill the sketch, no more than expected and five deviations.
    most = (F.col("n") + F.col("m")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    bits = F.least(most, (1 - F.exp(most * (-2 / ODD))) * (ODD / 2) + 2.5 * ODD**0.5)
    may = (apart[0] + apart[1] <= REGISTERS - LIKELY) & (sum(apart[3:], apart[2]) <= bits)
    pairs = buckets.join(lead, "value").filter(after & close & may & (F.col("root") != F.col("leader_root"))).select(F.col("node").alias("a"), F.col("leader").alias("b"), F.col("root").alias("ra"), F.col("leader_root").alias("rb")).distinct()
    both = pairs.join(els.select(F.col("node").alias("a"), F.col("els").alias("x")), "a").join(els.select(F.col("node").alias("b"), F.col("els").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= SIMILARITY * (F.size("x") + F.size("y") - common)).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def links(docs: DataFrame, sigs: DataFrame) -> DataFrame:
    """node, rep, root: the smallest doc_id and the class of every node; one of no link is its own root."""
    nodes = stage(sigs.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", *REGISTER_BITS)]), "nodes")
    members = stage(crowded(nodes), "members")
    roots = members.select("node", F.col("node").alias("root"))
    els = stage(_element_sets(docs, members.select("node", "rep")), "elements")
    # value, node, n, BITS, central, root, size: a row for each member of a bucket.
    buckets = stage(members.join(els.select("node", *ODD_BITS), "node").select(F.explode("values").alias("value"), "node", "n", *BITS, "central", F.col("node").alias("root"), F.lit(SMALL + 1).cast("long").alias("size")), "buckets")
    turn, held = 0, [buckets]
    move = lambda d, c, m: d.join(m.withColumnsRenamed({"root": c}), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    while not buckets.isEmpty():
        lead = elect(buckets if turn else buckets.filter("pmod(value, 3) = 0"), min(1024, 4 ** max(0, turn - 1)))
        # The links of a round join classes of the rounds before: only those that are joined take part.
        moved = components(compare(buckets, lead, els)).filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("new"))
        roots = move(roots, "root", moved)
        # Who is in a leader's class, and the leaders, are done in the bucket; the others elect again.
        led = move(lead.select("value", F.col("leader_root").alias("root")), "root", moved).distinct()
        left = stage(move(buckets, "root", moved).join(led, ["value", "root"], "left_anti"), "left")
        several = left.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("value", "size" if turn else F.lit(SMALL + 1).cast("long").alias("size"))
        buckets = stage(left.drop("size").join(several, "value"), "buckets")
        discard(left, *held[1:])
        held[1:] = [buckets]
        turn += 1
    # Members that joined a leader left the buckets, so others have not met them there.
    roots = stage(roots, "joined")
    rest = mixed(held[0], roots, members, els)
    held += [roots, rest]
    roots = move(roots, "root", components(compare(rest, _as_leaders(rest.filter("central = 1")), els)).filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("new")))
    out = stage(nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    discard(*held, els, members, nodes)
    return out


def _element_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, els, ODD_BITS of the wanted nodes, made from the whole text of one row of each. Rows are dealt by node and doc_id, so that copies go apart."""
    one = wanted.select("node", F.col("rep").alias("doc_id"))
    d = _keyed(docs).alias("d").join(one.alias("w"), (F.col("d.node") == F.col("w.node")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    return d.select("node", "text").mapInArrow(_elements, "node binary, els array<bigint>, " + ", ".join(f"{c} long" for c in ODD_BITS))


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links of one task, by union-find: a root is the smallest node of its tree."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    for i in range(0, len(nodes), 10_000):
        some = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(list(map(root, some)), pa.binary())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node -> root: the smallest node of its component. Up to FEW_LINKS links are one task's; for more, labels spread and jump until none changes."""
    edges = stage(edges.select("a", "b"), "links")
    if edges.count() <= FEW_LINKS:
        found = stage(edges.coalesce(1).mapInArrow(_joined_up, "node binary, root binary"), "roots")
        discard(edges)
        return found
    both = stage(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("node"), F.col("e.b").alias("to")).distinct(), "edges")
    discard(edges)
    label = stage(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        near = both.join(label.select(F.col("node").alias("to"), F.col("root").alias("r")), "to").groupBy("node").agg(F.min("r").alias("r"))
        spread = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = stage(spread.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "roots")
        changed = not after.filter("old <> root").isEmpty()
        discard(label)
        label = after
        if not changed:
            discard(both)
            return label.select("node", "root")


def _classed(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, first: whether the row is the one that stands for its class."""
    sigs = stage(_keyed(docs).mapInArrow(_sign, "doc_id long, node binary, n long, bands array<bigint>, " + ", ".join(f"{c} long" for c in REGISTER_BITS)), "signatures")
    roots = links(docs, sigs)
    # Null ids come last.
    ids = roots.groupBy("root").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "node")).alias("least"))
    by_node = stage(roots.join(ids, "root").select(F.col("node").alias("_node"), F.col("least.rep").alias("class_id"), (F.col("node") == F.col("least.node")).alias("least")), "classes")
    worded = F.col("n") > 0
    out = sigs.join(by_node, F.when(worded, F.col("node")) == F.col("_node"), "left")
    return out.select("doc_id", "node", F.when(worded, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), (~worded | (F.col("least") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("first"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class."""
    return _classed(docs).select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each class: that of the smallest doc_id, with all its columns. Of rows that are equal in doc_id and text, one stays."""
    key = lambda node: F.concat(node, F.coalesce(F.col("doc_id").cast("long").cast("string").cast("binary"), F.lit(b"")))
    keep = stage(_classed(docs).filter("first").select(key(F.col("node")).alias("kept")).distinct(), "kept")
    keyed = docs.select(packed(docs), key(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))).alias("kept"))
    return keyed.join(keep, "kept", "left_semi").dropDuplicates(["kept"]).select("row.*")
