"""Operator 9: mix sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks of about BLOCK documents by a hash. A source's target is met by whole passes over its
blocks and one partial pass over blocks in a permuted order, whose last block is cut at a hash threshold. What a source
gives, its quota, is a number of draws, one for each block of a pass. The quotas of all sources are split recursively among
the output shards (a power of two of them, of about SHARD draws): a node of the tree gives half of its draws to the left, and how many of
them come from each source is drawn from the multivariate hypergeometric distribution, one source after the other. Quotas stay exact. A shard then
gets the next of each source's permuted draws, as many as its quota, so no draw goes to two shards.
Documents are ordered by a hash inside their shard.

The tree works on numbers of draws: a row for each node, with a number for each source; levels are split in place, without a
shuffle. Places in a permuted order are computed, not sorted, and sums along it are made in
groups of CHUNK blocks, so a source with a third of all rows is many blocks and no large window.

Defined results: null text has size 0 and takes 0 words; null source comes last in the order of
sources; rows equal in doc_id and text share a block and are taken alike, as are different ones of equal 64-bit hashes in a block; a text of any
length is counted whole; an empty table gives an empty mix; the caller's columns, whatever their names, come through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, packed, row_key, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 1024
#: Draws of a shard, at most.
SHARD = 16
CHUNK = 1024
SEED = 20_240_607
#: A prime beyond every number of blocks: its multiples permute them.
PRIME = (1 << 31) - 1


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of keep), size, src (null kept apart), h (order within a block)."""
    return docs.select(
        packed(docs, keep),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("src"),
        F.xxhash64(row_key("doc_id", "text"), F.lit(SEED)).alias("h"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """src, source_size, n_docs -> with target: weighted shares of SHARE of all words, filled up to MOST of a source."""
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy("src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", MOST * F.col("source_size")).withColumn("all", SHARE * F.sum("source_size").over(one))
    fill = one.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.sum("w").over(one) - F.coalesce(F.sum("w").over(fill), F.lit(0.0))))
    # Sources up to the first whose cap is beyond the level are full; that level holds for the others.
    t = t.withColumn("lambda", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "src", F.col("level").alias("x")))).over(one)["x"])
    return t.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("lambda") * F.col("w")), F.col("cap"))).select("src", "source_size", "n_docs", "target")


def _n_blocks(n_docs: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n_docs / BLOCK)).cast("long")


def _block(n_docs: Column) -> Column:
    return F.pmod(F.xxhash64("h", F.lit(1)), _n_blocks(n_docs))


def _place(block: Column, n: Column, turn: Column) -> Column:
    """A block's place in the permuted order of a pass. Blocks are dealt by a hash, so multiples of a prime permute their contents at random."""
    return F.pmod(block * F.lit(PRIME) + F.pmod(F.xxhash64("src", turn, F.lit(SEED)), n), n)


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of drawn are good, of total with so many good ones: the number at which the distribution passes u.

    Weights are made from one likely number outwards, by the ratio of neighbours, up to twelve deviations from the mean."""
    t, g, d = (x.cast("double") for x in (total, good, drawn))
    mean = d * g / F.greatest(t, F.lit(1.0))
    reach = 12 * F.sqrt(mean * (1 - g / F.greatest(t, F.lit(1.0))) * (t - d) / F.greatest(t - 1, F.lit(1.0))) + 12
    lo = F.greatest(F.lit(0.0), d - (t - g), F.floor(mean - reach))
    hi = F.least(g, d, F.ceil(mean + reach))
    ratio = lambda x: (g - x) * (d - x) / ((x + 1) * (t - g - d + x + 1))  # noqa: E731  of the weights of x + 1 and x

    def pick(weights: Column) -> Column:
        whole = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
        zero = F.struct((u * whole).alias("left"), F.lit(0).cast("long").alias("k"))
        return F.aggregate(weights, zero, lambda a, w: F.struct((a["left"] - w).alias("left"), F.when(a["left"] > w, a["k"] + 1).otherwise(a["k"]).alias("k")), lambda a: a["k"])

    # Sums of the ratios' logarithms, from the first number on, less the largest: no weight overflows.
    steps = F.transform(F.sequence(lo.cast("long"), F.greatest(hi, lo).cast("long")), lambda x: x.cast("double"))
    zero = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("out"))
    logs = F.aggregate(steps, zero, lambda a, x: F.struct((a["at"] + F.log(F.greatest(ratio(x), F.lit(1e-300)))).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    weights = let(logs, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return F.least(hi.cast("long"), lo.cast("long") + let(weights, pick))


def split(nodes: DataFrame, level: int) -> DataFrame:
    """shard, quotas (src, k): each node as its left and right half."""

    def draw(acc: Column, q: Column) -> Column:
        u = (F.pmod(F.xxhash64("shard", q["src"], F.lit(SEED + level)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        k = _hypergeometric(acc["total"], q["k"], acc["left"], u)
        # The number is bound once: an array of one element.
        return let(k, lambda k: F.struct((acc["total"] - q["k"]).alias("total"), (acc["left"] - k).alias("left"), F.concat(acc["out"], F.array(k)).alias("out")))

    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["k"])
    zero = F.struct(F.col("total"), F.floor(F.col("total") / 2).cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))
    half = nodes.withColumn("total", total).withColumn("lefts", F.aggregate("quotas", zero, draw, lambda a: a["out"]))
    side = lambda right: F.struct((F.col("shard") * 2 + right).alias("shard"), F.zip_with("quotas", "lefts", lambda q, k: F.struct(q["src"].alias("src"), (q["k"] - k if right else k).alias("k"))).alias("quotas"))
    # Two rows for each: a generator keeps the levels' expressions apart.
    return half.select(F.explode(F.array(side(0), side(1))).alias("s")).select("s.*")


def shard_quotas(quotas: DataFrame, draws: int) -> DataFrame:
    """src, k -> shard, src, k, where a shard has at most SHARD draws in all: the leaves of the tree."""
    nodes = quotas.filter("k > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("src", F.col("k").cast("long").alias("k")))).alias("quotas")).select(F.lit(0).cast("long").alias("shard"), "quotas")
    levels = max(0, math.ceil(math.log2(max(1, draws) / SHARD)))
    for level in range(levels):
        nodes = split(nodes, level)
        if level % 4 == 3:
            nodes = stage(nodes, "nodes")
    return nodes.select("shard", F.explode("quotas").alias("q")).select("shard", "q.src", "q.k").filter("k > 0")


def plan(small: DataFrame) -> DataFrame:
    """src, size, h of all documents -> one row per source and block: the shards that draw it, whether its last draw is cut and where."""
    per = stage(targets(small.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumns({"n": _n_blocks(F.col("n_docs")), "passes": passes}).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    dealt = small.join(per.select("src", "n_docs"), "src").withColumn("block", _block(F.col("n_docs")))
    blocks = dealt.groupBy("src", "block").agg(F.sum("size").alias("words")).join(per, "src")
    # The partial pass: sums along the permuted order, first of chunks, then inside them.
    blocks = stage(blocks.withColumn("place", _place(F.col("block"), F.col("n"), F.col("passes"))).withColumn("chunk", F.floor(F.col("place") / CHUNK)), "blocks")
    ahead = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    chunks = blocks.groupBy("src", "chunk").agg(F.sum("words").alias("words")).select("src", "chunk", F.coalesce(F.sum("words").over(ahead(["src"], "chunk")), F.lit(0)).alias("ahead"))
    before = F.col("ahead") + F.coalesce(F.sum("words").over(ahead(["src", "chunk"], "place")), F.lit(0))
    blocks = blocks.join(chunks, ["src", "chunk"]).withColumn("left", F.col("rest") - before)
    # 2: the partial pass takes the block, 1: a part of it, 0: none of it. Blocks without words go with the last that is taken.
    blocks = stage(blocks.withColumn("part", F.when(F.col("left") >= F.greatest("words", F.lit(1)), 2).when(F.col("left") > 0, 1).otherwise(0)), "parts")
    edge = dealt.join(blocks.filter("part = 1").select("src", "block", "left"), ["src", "block"]).groupBy("src", "block", "h").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
    run = F.sum("size").over(Window.partitionBy("src", "block").orderBy("h"))
    near = edge.withColumn("run", run).filter(F.col("run") - F.col("size") / 2 <= F.col("left")).groupBy("src", "block").agg(F.max("h").alias("cut"))
    # Draws of a source: pass after pass, by place.
    taken = blocks.groupBy("src").agg(F.max(F.when(F.col("part") > 0, F.col("place") + 1)).alias("partial"), F.first("n").alias("n"), F.first("passes").alias("passes"))
    quotas = stage(taken.select("src", (F.col("passes") * F.col("n") + F.coalesce("partial", F.lit(0))).alias("k")), "quotas")
    total = quotas.agg(F.sum("k")).first()[0] or 0
    leaves = stage(shard_quotas(quotas, total), "leaves")
    begin = F.coalesce(F.sum("k").over(ahead(["src"], "shard")), F.lit(0))
    owners = leaves.withColumn("begin", begin).select("src", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("k") - 1)).alias("draw"))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(int(MOST)).cast("long")), lambda t: F.struct(t.alias("turn"), F.when(t < F.col("passes"), t * F.col("n") + _place(F.col("block"), F.col("n"), t)).when((t == F.col("passes")) & (F.col("part") > 0), t * F.col("n") + F.col("place")).alias("draw")))
    draws = blocks.select("src", "block", F.explode(F.filter(whole, lambda x: x["draw"].isNotNull())).alias("d")).select("src", "block", "d.turn", "d.draw")
    shards = draws.join(owners, ["src", "draw"]).groupBy("src", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards"))
    out = blocks.join(near, ["src", "block"], "left").join(shards, ["src", "block"], "left")
    none = F.array().cast("array<bigint>")
    return stage(out.select("src", "block", "part", "cut", F.coalesce("shards", none).alias("shards"), "target", "source_size"), "mix-plan")


def mix(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of keep), size, h, shards (those that take the document, one for each time), target and source_size."""
    small = stage(sized(docs, []).drop("row"), "sizes")
    p = plan(small)
    counts = stage(small.groupBy("src").agg(F.count("*").alias("n_docs")), "counts")
    d = sized(docs, keep).join(counts, "src").withColumn("block", _block(F.col("n_docs"))).drop("n_docs").join(p, ["src", "block"])
    spared = (F.col("part") == 1) & ~F.coalesce(F.col("h") <= F.col("cut"), F.lit(False))
    shards = F.when(spared, F.slice("shards", F.lit(1), F.size("shards") - 1)).otherwise(F.col("shards"))
    return d.select("row", "size", "h", shards.alias("shards"), "target", "source_size")


def mixed_shards(docs: DataFrame) -> DataFrame:
    """row (a struct of docs' columns) and shard: each document as often as it is drawn, shard by shard, shuffled inside each."""
    out = mix(docs, docs.columns).select("row", "h", F.explode("shards").alias("shard"))
    return out.repartition("shard").sortWithinPartitions("shard", F.xxhash64("h", "shard", F.lit(SEED))).select("row", "shard")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs."""
    return mixed_shards(docs).select("row.*")
