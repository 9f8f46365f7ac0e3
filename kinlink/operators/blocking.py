"""Blocking: keys of names and addresses, capped buckets, candidate pairs.

All kinds of key are rows of one table (index, key), so one equi-join finds all candidates. Buckets
are cut to their first records before the join, so a hot key can't multiply rows; Spark cuts them in
each task before the shuffle too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the passes, most records of a bucket, most candidates, most frequent rare token.
WEIGHTS = {"exact": 100.0, "concat": 50.0, "sorted": 40.0, "number_word": 30.0, "number_prefix": 20.0, "pair": 10.0, "rare": 5.0}
MAX_FREQUENCY = 150
NAME_BUCKET = 200
ADDRESS_BUCKET = 100
MAX_CANDIDATES = 80


def _pairs(t: Column) -> Column:
    return F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.lit(3)), lambda y: F.concat(x, F.lit("\x1f"), y))))


def _exploded(prepared: DataFrame, sets: dict[str, Column], by: list[str]) -> DataFrame:
    tag = lambda name: lambda k: F.struct(F.lit(name).alias("index"), k.alias("key"))
    every = F.flatten(F.array(*[F.transform(F.array_distinct(v), tag(name)) for name, v in sets.items()]))
    return prepared.select("entity_id", "pos", *by, F.explode(every).alias("k")).select(*by, "k.index", "k.key", "entity_id", "pos")


def _name_sets() -> dict[str, Column]:
    c = F.col("core_tokens")
    many, none = F.size(c) > 1, F.expr("cast(array() as array<string>)")
    only = lambda ok, k: F.when(ok, F.array(k)).otherwise(none)
    return {
        "exact": only(F.size(c) > 0, F.array_join(c, " ")),
        "concat": F.filter(F.array(F.array_join(F.slice(c, 1, 4), "")), lambda k: F.length(k) >= 5),
        "sorted": only(many, F.array_join(F.array_sort(c), " ")),
        "pair": F.when(many, _pairs(c)).otherwise(none),
        "rare": c,
    }


def _address_sets() -> dict[str, Column]:
    none = F.expr("cast(array() as array<string>)")
    words = F.filter("address_words", lambda w: F.length(w) >= 4)
    first, word = F.get("address_numbers", F.lit(0)), F.get("name_words", F.lit(0))
    return {
        "number_word": F.flatten(F.transform(F.slice("address_numbers", 1, 2), lambda n: F.transform(words, lambda w: F.concat(n, F.lit("\x1f"), w)))),
        "number_prefix": F.when(first.isNotNull() & word.isNotNull(), F.array(F.concat(first, F.lit("\x1f"), F.substr(word, F.lit(1), F.lit(3))))).otherwise(none),
    }


def name_keys(prepared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, index, key, entity_id, pos: all keys of names; rare tokens are not yet cut by frequency."""
    return _exploded(prepared, _name_sets(), by or [])


def address_keys(prepared: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _exploded(prepared, _address_sets(), by or [])


def keys(prepared: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _exploded(prepared, _name_sets() | _address_sets(), by or [])


def token_frequency(k: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, key, df: in how many records a core token is."""
    return k.filter("index = 'rare'").groupBy(*(by or []), "key").agg(F.count("*").alias("df"))


def _rare(k: DataFrame, max_frequency: int, by: list[str]) -> DataFrame:
    """The keys without tokens that are too frequent for their length."""
    short = (F.length("key") >= 3) & (F.col("df") <= max_frequency) | (F.length("key") >= 6) & (F.col("df") <= 2 * max_frequency)
    rare = token_frequency(k, by).filter(short).select(*by, "key")
    return k.filter("index <> 'rare'").unionByName(k.filter("index = 'rare'").join(rare, [*by, "key"], "left_semi").select(*k.columns))


def _first(k: DataFrame, cap: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, "index", "key").orderBy("pos", "entity_id")
    return k.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def build_name_index(targets: DataFrame, max_frequency: int = MAX_FREQUENCY, max_bucket: int = NAME_BUCKET, by: list[str] | None = None) -> DataFrame:
    """The capped buckets of the targets' names, to build once and probe often. targets: prepared."""
    return _first(_rare(name_keys(targets, by), max_frequency, by or []), max_bucket, by or [])


def build_address_index(targets: DataFrame, max_bucket: int = ADDRESS_BUCKET, by: list[str] | None = None) -> DataFrame:
    return _first(address_keys(targets, by), max_bucket, by or [])


build_fast_name_index = build_name_index
build_fast_address_index = build_address_index


def index_targets(targets: DataFrame, max_frequency: int = MAX_FREQUENCY, max_bucket: int = NAME_BUCKET, by: list[str] | None = None) -> DataFrame:
    """Both indexes of the targets as one table."""
    return build_name_index(targets, max_frequency, max_bucket, by).unionByName(build_address_index(targets, ADDRESS_BUCKET, by))


def _probe(asked: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """source1_entity_id, candidate_entity_id, weight: every pair that shares a bucket, with the weights of those that it shares."""
    found = index.select(*by, "index", "key", F.col("entity_id").alias("candidate_entity_id"))
    weight = F.element_at(F.create_map(*[F.lit(x) for n, v in WEIGHTS.items() for x in (n, v)]), F.col("index"))
    return asked.withColumnRenamed("entity_id", "source1_entity_id").join(found, [*by, "index", "key"]).groupBy("source1_entity_id", "candidate_entity_id").agg(F.sum(weight).alias("weight"))


def generate_name_candidates(source: DataFrame, index: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_id of pairs that share a bucket of a name index."""
    return _probe(name_keys(source), index, []).drop("weight")


def generate_address_candidates(source: DataFrame, index: DataFrame) -> DataFrame:
    return _probe(address_keys(source), index, []).drop("weight")


def compatible(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b)


def top_candidates(pairs: DataFrame, order: list[Column], most: int | None) -> DataFrame:
    if not most:
        return pairs
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("source1_entity_id").orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def candidates(source: DataFrame, targets: DataFrame, max_candidates: int | None = MAX_CANDIDATES, index: DataFrame | None = None) -> DataFrame:
    """source1_entity_id, candidate_entity_id, weight of pairs of compatible countries: those of most shared words of each source record, then of the larger id. source, targets: prepared."""
    pairs = _probe(keys(source), index_targets(targets) if index is None else index, [])
    side = lambda d, key, i: d.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{i}") for c in ("core_tokens", "address_words", "country")])
    both = pairs.join(side(source, "source1_entity_id", 1), "source1_entity_id").join(side(targets, "candidate_entity_id", 2), "candidate_entity_id")
    both = both.filter(compatible(F.col("country_1"), F.col("country_2")))
    overlap = 2 * F.size(F.array_intersect("core_tokens_1", "core_tokens_2")) + F.size(F.array_intersect("address_words_1", "address_words_2"))
    return top_candidates(both.withColumn("overlap", overlap), [F.desc("overlap"), F.desc("candidate_entity_id")], max_candidates).select("source1_entity_id", "candidate_entity_id", "weight")


def fast_candidates(source: DataFrame, targets: DataFrame, max_candidates: int | None = MAX_CANDIDATES, partition: str | None = None) -> DataFrame:
    """source1_entity_id, candidate_entity_id, weight: the pairs of most weight of each source record, then of the smaller id, whatever the normal form of
    their countries. partition: a column in which both sides must be equal, each of whose values has indexes of its own."""
    by = [partition] if partition else []
    pairs = _probe(keys(source, by), index_targets(targets, by=by), by)
    return top_candidates(pairs, [F.desc("weight"), F.asc("candidate_entity_id")], max_candidates)


def candidate_lists(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """A row for every source record, with pos where it has one: its candidates, sorted and joined by commas, or an empty string."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias("candidate_entity_ids"))
    pos = ["pos"] if "pos" in source.columns else []
    return source.select(F.col("entity_id").alias("source1_entity_id"), *pos).join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("candidate_entity_ids", F.lit("")).alias("candidate_entity_ids"), *pos)


def evaluate_blocking(pairs: DataFrame, truth: DataFrame, n_targets: int) -> DataFrame:
    """One row: recall, candidate counts and reduction. pairs hold every source record's candidates; truth: source1_entity_id, candidate_entity_id.

    The counts are gathered as rows of one kind each and summed, so nothing is joined but pairs to pairs."""
    pair = ["source1_entity_id", "candidate_entity_id"]
    hit = truth.select(*pair).withColumn("kind", F.lit(1)).unionByName(pairs.filter("candidate_entity_id is not null").select(*pair).withColumn("kind", F.lit(0))).groupBy(*pair).agg(F.count_if(F.col("kind") == 1).alias("t"), F.count_if(F.col("kind") == 0).alias("c"))
    counted = hit.agg(F.sum("t").alias("true_pairs"), F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("true_retrieved")).select(F.lit(1).alias("one"), F.coalesce("true_pairs", F.lit(0)).alias("true_pairs"), F.coalesce("true_retrieved", F.lit(0)).alias("true_retrieved"))
    per = pairs.groupBy("source1_entity_id").agg(F.count("candidate_entity_id").alias("n"))
    a = per.agg(F.lit(1).alias("one"), F.count("*").alias("n_source"), F.sum("n").alias("n_candidates"), F.avg("n").alias("avg_candidates"), F.median("n").alias("median_candidates"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"))
    both = a.join(counted, "one")
    return both.select("true_pairs", "true_retrieved", F.when(F.col("true_pairs") == 0, 1.0).otherwise(F.col("true_retrieved") / F.greatest("true_pairs", F.lit(1))).alias("recall"), "n_candidates", "avg_candidates", "median_candidates", "min_candidates", "max_candidates", (1 - F.col("n_candidates") / F.greatest(F.col("n_source") * F.lit(n_targets), F.lit(1))).alias("reduction"))
